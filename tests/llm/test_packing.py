import os
import random
from collections import Counter

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import packing as P


def loads(histogram, capacity, **kw):
    """Every rank of every length once, and what each container holds."""
    plan, n = P.plan(histogram, capacity, **kw)
    held, ranks = Counter(), {}
    for length, a, b, first, per in plan:
        ranks.setdefault(length, []).append((a, b))
        for r in range(a, b):
            held[first + (r - a) // per] += length
    for length, count in histogram.items():
        at = 0
        for a, b in sorted(ranks.get(length, [])):
            assert a == at and b > a
            at = b
        assert at == count
    assert set(held) == set(range(n)) and all(0 < v <= capacity for v in held.values())
    return held


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 30), max_size=20), st.integers(1, 8))
def test_any_histogram_is_packed_whole(histogram, groups):
    loads(histogram, 60, groups=groups)


def test_little_room_is_left():
    rnd = random.Random(1)
    histogram = Counter(min(4096, max(1, int(rnd.lognormvariate(6.3, 1.1)))) for _ in range(4000))
    held = loads(histogram, 4096)
    total = sum(k * v for k, v in histogram.items())
    assert len(held) <= 1.02 * -(-total // 4096)


def test_large_lengths_alone_use_configurations():
    # 30 + 30 fill a container of 60, 45 leaves 15, 20 x 3
    held = loads({30: 10, 45: 4, 15: 4, 20: 6}, 60)
    assert len(held) == 5 + 4 + 2


def test_the_plan_does_not_grow_with_the_number_of_documents():
    histogram = {n: 1 + n % 7 for n in range(1, 300)}
    small, _ = P.plan(histogram, 300)
    large, _ = P.plan({k: v * 1000 for k, v in histogram.items()}, 300)
    assert len(large) < 4 * len(small) + 100


def test_documents_are_assigned_as_planned(spark):
    rnd = random.Random(2)
    # one length has a third of all documents
    items = [(i, 0, 7 if i % 3 == 0 else rnd.randrange(1, 41)) for i in range(1500)] + [(5, 0, 7), (5, 0, 7)]
    df = spark.createDataFrame(items, "doc_id bigint, piece int, tokens int")
    packed = P.pack_items(df, 40)
    assert Counter((r["doc_id"], r["piece"], r["tokens"]) for r in packed.collect()) == Counter(items)
    fill = P.fill(packed, 40)
    assert fill.filter("tokens > 40 or room != 40 - tokens").count() == 0
    assert fill.count() <= 1.03 * -(-sum(n for *_, n in items) // 40) + 1


def test_only_long_documents_are_cut(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 10), (4, 11), (5, 25), (6, None)], "doc_id bigint, tokens bigint")
    assert rows(P.pieces(df, 10)) == [(2, 0, 1), (3, 0, 10), (4, 0, 10), (4, 1, 1), (5, 0, 10), (5, 1, 10), (5, 2, 5)]


@pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="no tokenizer files")
def test_whole_texts_are_counted_nulls_and_empties_left_out(spark):
    long = "word " * 9000
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, long), (1, "hello world")], "doc_id bigint, text string").withColumn("tokens", F.lit(0)).withColumn("container", F.lit("x"))
    counts = dict(rows(P.count_tokens(df).distinct()))
    assert counts[1] == 2 and counts[2] == 0 and counts[3] == 0 and counts[4] >= 9000
    packed = P.pack(df)
    assert packed.agg(F.sum("tokens")).first()[0] == 4 + counts[4]
    assert rows(packed.select("doc_id").distinct()) == [(1,), (4,)]
    assert rows(P.pack(df.limit(0))) == []

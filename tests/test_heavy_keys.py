import random
from decimal import Decimal

from conftest import rows
from pyspark.sql import functions as F

from tidewell.operators import heavy_keys as H

SCHEMA = "t string, p int, o bigint, f bigint, m decimal(18,6)"


def totals(spark, data):
    return H.key_totals(spark.createDataFrame(data, SCHEMA), ["t", "p"], "o", "f", "m")


def brute(data):
    by = {}
    for t, p, o, f, m in data:
        if t is not None and p is not None and o is not None:
            by.setdefault((t, p), {}).setdefault(o, []).append(((f is not None, f or 0), m))
    out = []
    for key, records in by.items():
        money = [max(v, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1] for v in records.values()]
        out.append((*key, len(records), sum(map(len, records.values())), max(records), sum((m or Decimal(0) for m in money), Decimal(0))))
    return sorted(out)


def test_totals_equal_brute_force_with_a_hot_key(spark):
    rnd = random.Random(2)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(300)}", rnd.randrange(2), rnd.randrange(400), rnd.choice([None, 1, 2, 3]), rnd.choice([None, Decimal(rnd.randrange(-(10**12), 10**12)) / 10**6])) for _ in range(3000)]
    data += [(None, 1, 1, 1, Decimal(1)), ("x", None, 1, 1, Decimal(1)), ("x", 1, None, 1, Decimal(1))]
    assert rows(totals(spark, data)) == brute(data)


def test_sums_beyond_64_bits(spark):
    big = Decimal("999999999999.999999")
    assert rows(totals(spark, [("a", 0, o, 1, big) for o in range(40)]))[0][-1] == big * 40
    assert rows(totals(spark, [("a", 0, o, 1, -big) for o in range(40)]))[0][-1] == -big * 40


def test_of_a_large_dictionary_the_heaviest_keys_are_broadcast_alone(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(H, "HEAVIEST", 10)
    monkeypatch.setattr(H, "OPEN_BLOCKS", 1)
    data = [(f"k{i % 50}", i % 3, i, 1, Decimal(i)) for i in range(500)] + [("hot", 0, i, 1, Decimal(i)) for i in range(300)]
    assert rows(totals(spark, data)) == brute(data)


def test_heavy_share_is_inclusive(spark):
    data = [("a", 0, o, 1, Decimal(0)) for o in range(4)] + [(f"b{o}", 0, o, 1, Decimal(0)) for o in range(96)]
    assert rows(H.heavy_keys(totals(spark, data), ["t", "p"])) == [("a", 0)]


def test_empty_and_clashing_columns(spark):
    assert rows(totals(spark, [])) == []
    df = spark.createDataFrame([("a", 0, 1, 1, Decimal(1))], SCHEMA).withColumn("code", F.lit(9)).withColumn("records", F.lit(9)).withColumn("__b", F.lit(1))
    assert rows(H.key_totals(df, ["t", "p"], "o", "f", "m")) == [("a", 0, 1, 1, 1, Decimal(1))]

import random

from conftest import rows

from tidewell.operators import scan


def test_running_max_equals_brute_force_over_blocks_and_keys(spark):
    rnd = random.Random(1)
    data = [("hot" if rnd.random() < 0.6 else "cold", rnd.randrange(200), rnd.choice([None, rnd.randrange(1000)])) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, o bigint, v bigint")
    for inclusive in (False, True):
        got = rows(scan.running_max(df, ["k"], "o", "v", "m", inclusive=inclusive, bits=3).select("k", "o", "v", "m"))
        want = []
        for k, o, v in data:
            below = [x for j, p, x in data if j == k and x is not None and (p < o or (inclusive and p == o))]
            want.append((k, o, v, max(below, default=None)))
        assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_running_max_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, o bigint, v bigint")
    assert rows(scan.running_max(df, ["k"], "o", "v", "m")) == []


def test_running_count_ranks_across_ranges_with_ties_and_null_keys(spark):
    data = [("a" if i % 3 else None, -1 if i % 2 else (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(data, "k string, o bigint, i bigint")
    got = {(r["k"], r["o"], r["i"]): r["n"] for r in scan.running_count(df, ["k"], ["o", "i"], "n").collect()}
    for key in ("a", None):
        ordered = sorted((x for x in data if x[0] == key), key=lambda x: (x[1], x[2]))
        assert [got[x] for x in ordered] == list(range(len(ordered)))


def test_staged_data_is_released(spark):
    from tidewell import session

    before = session.staged_so_far()
    df = session.staged(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and session.staged_so_far() == before + 1
    session.release(before)
    assert session.staged_so_far() == before

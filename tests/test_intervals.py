import random

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import intervals

SCHEMA = "g string, t string, s bigint, e bigint"


def brute(data):
    covered = {}
    for g, t, s, e in data:
        if s is not None and e is not None and e >= s:
            covered.setdefault((g, t), set()).update(range(s, e + 1))
    periods, gaps = [], []
    for key, c in covered.items():
        run = None
        for x in range(min(c), max(c) + 2):
            if x in c and run is None:
                run = x
            if x not in c and run is not None:
                periods.append((*key, run, x - 1))
                run = None
        run = None
        for x in range(min(c), max(c) + 1):
            if x not in c and run is None:
                run = x
            if x in c and run is not None:
                gaps.append((*key, run, x - 1))
                run = None
    order = lambda r: [(x is not None, x) for x in r]
    return sorted(periods, key=order), sorted(gaps, key=order)


def check(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    periods, gaps = brute(data)
    assert rows(intervals.periods(df, ["g", "t"], "s", "e")) == periods
    assert rows(intervals.gaps(df, ["g", "t"], "s", "e")) == gaps


def test_overlaps_nesting_touching_and_gaps(spark):
    check(spark, [("a", "x", 0, 9), ("a", "x", 3, 5), ("a", "x", 10, 12), ("a", "x", 20, 20), ("a", "x", 15, 15), ("b", "x", 7, 8), ("a", "x", 0, 9)])


def test_unusable_rows_and_null_entities(spark):
    check(spark, [("a", None, 1, 3), ("a", None, 6, 7), ("a", "x", None, 4), ("a", "x", 4, None), ("a", "x", 9, 8), (None, None, 5, 5)])


def test_one_entity_with_most_rows(spark):
    rnd = random.Random(5)
    check(spark, [("hot", "x", s := rnd.randrange(3000), s + rnd.randrange(6)) for _ in range(500)] + [("a", "x", 1, 2)])


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(intervals.gaps(df, ["g", "t"], "s", "e")) == [] and rows(intervals.periods(df, ["g", "t"], "s", "e")) == []
    df = spark.createDataFrame([("a", "x", 1, 2), ("a", "x", 5, 6)], SCHEMA).withColumn("__k0", F.lit(1)).withColumn("gap_start", F.lit(2)).withColumn("__e", F.lit(2))
    assert rows(intervals.gaps(df, ["g", "t"], "s", "e")) == [("a", "x", 3, 4)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["x", None]), st.one_of(st.none(), st.integers(-20, 40)), st.one_of(st.none(), st.integers(-20, 40))), max_size=25))
def test_any_intervals(spark, data):
    check(spark, data)

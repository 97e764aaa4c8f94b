import random
from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewell.commit.incremental import IncrementalRuns
from tidewell.operators import changes as C

TAB = "_file_id bigint, _topic string, _partition int, _offset bigint, id int, name string, timestamp timestamp_ntz, height double, width float, is_enabled boolean, child_ids array<int>, parent_id bigint, transaction_id string, money_spent decimal(18,6)"
LED = "run_id bigint, attempt int, _topic string, _partition int, _start_offset bigint, _end_offset bigint, _max_file_id bigint, run_state string, logged_at timestamp_ntz"


def table(spark, data):
    """data: (file, topic, partition, offset, id)"""
    full = [(f, t, p, o, i, "n", datetime(2023, 1, 1), 1.0, 2.0, True, [1], None, "t", Decimal(1)) for f, t, p, o, i in data]
    return spark.createDataFrame(full, TAB)


def ledger(spark, data):
    """data: (run, attempt, topic, partition, start, end, max_file, state, second)"""
    return spark.createDataFrame([(*r[:8], datetime(2023, 1, 1, 0, 0, r[8])) for r in data], LED)


def brute(tab, led):
    last = {}
    for run, att, *rest in led:
        key = (run, att)
        if key not in last or rest[6] > last[key][6]:
            last[key] = rest
    ok = [r for r in last.values() if r[5] == "committed"]
    out = set()
    by = {}
    for f, t, p, o, i in tab:
        if t is not None and p is not None and o is not None:
            by.setdefault((t, p, o), []).append((f, i))
    for (t, p, o), versions in by.items():
        seen = max((r[4] for r in ok if r[0] == t and r[1] == p and r[2] <= o <= r[3]), default=None)
        old = [v for v in versions if v[0] is not None and seen is not None and v[0] <= seen]
        newest = max(versions, key=lambda v: (v[0] is not None, v[0] or 0))
        if seen is None or not old or max(old)[1] != newest[1]:
            out.add((t, p, o))
    return out


def test_states_of_attempts_and_overlapping_ranges(spark):
    tab = [(5, "a", 0, o, 1) for o in range(30)] + [(9, "a", 0, 3, 2), (9, "a", 0, 4, 1), (None, "a", 0, 40, 1), (5, None, 0, 1, 1), (5, "a", 0, 12, 1), (20, "a", 0, 13, 7)]
    led = [
        (1, 1, "a", 0, 0, 9, 6, "staged", 1), (1, 1, "a", 0, 0, 9, 6, "committed", 2), (1, 1, "a", 0, 0, 9, 6, "committed", 2),
        (2, 1, "a", 0, 8, 20, 30, "committed", 3), (2, 1, "a", 0, 8, 20, 30, "rolled_back", 4), (2, 2, "a", 0, 10, 15, 6, "committed", 9), (3, 1, "a", 0, 12, 12, 4, "committed", 9), (4, 1, "a", 0, 35, 45, 50, "committed", 9),
    ]
    assert set(rows(C.to_process(table(spark, tab), ledger(spark, led)))) == brute(tab, led)


def test_random_ledgers_equal_brute_force(spark):
    rnd = random.Random(11)
    tab = list({(f, o): (f, rnd.choice("ab"), 0, o, rnd.randrange(3)) for f, o in ((rnd.randrange(60), rnd.randrange(700)) for _ in range(900))}.values())
    led = [(r, 1, rnd.choice("ab"), 0, s := rnd.randrange(700), s + rnd.randrange(-2, 200), rnd.randrange(60), rnd.choice(["committed", "committed", "failed", "staged"]), r % 60) for r in range(40)]
    assert set(rows(C.to_process(table(spark, tab), ledger(spark, led)))) == brute(tab, led)


def test_empty_ledger_and_empty_table(spark):
    tab = [(1, "a", 0, 1, 1), (2, "a", 0, 1, 1)]
    assert rows(C.to_process(table(spark, tab), ledger(spark, []))) == [("a", 0, 1)]
    assert rows(C.to_process(table(spark, []), ledger(spark, [(1, 1, "a", 0, 0, 9, 6, "committed", 2)]))) == []


def test_any_column_change_counts_and_nulls_are_told_apart(spark):
    led = ledger(spark, [(1, 1, "a", 0, 0, 99, 1, "committed", 2)])
    none = lambda kind: F.lit(None).cast(kind)
    base = table(spark, [(1, "a", 0, o, 1) for o in range(8)]).withColumn("child_ids", F.when(F.col("_offset") == 6, none("array<int>")).otherwise(F.col("child_ids")))
    edits = [
        ("name", none("string")), ("parent_id", F.lit(0).cast("bigint")), ("child_ids", F.expr("array(cast(1 as int), null)")), ("money_spent", F.lit("1.000001").cast("decimal(18,6)")),
        ("transaction_id", F.lit("")), ("timestamp", none("timestamp_ntz")), ("child_ids", F.expr("cast(array() as array<int>)")),
    ]
    second = base.withColumn("_file_id", F.lit(2).cast("bigint"))
    for offset, (column, value) in enumerate(edits):
        second = second.withColumn(column, F.when(F.col("_offset") == offset, value).otherwise(F.col(column)))
    assert rows(C.to_process(base.unionByName(second), led)) == [("a", 0, o) for o in range(7)]  # offset 7 came again unchanged


def test_extra_columns_with_clashing_names(spark):
    t = table(spark, [(1, "a", 0, 1, 1)]).withColumn("row", F.lit(1)).withColumn("seen", F.lit(1)).withColumn("__block", F.lit(1)).withColumn("current", F.lit(1))
    assert rows(C.to_process(t, ledger(spark, []))) == [("a", 0, 1)]


def test_runs_skip_nothing_and_repeat_nothing_across_failures(spark, tmp_path):
    runs = IncrementalRuns(spark, str(tmp_path / "runs"))
    first = [(1, "a", 0, o, 1) for o in range(600)] + [(1, "b", 0, 5, 1)]
    assert runs.pending(table(spark, first)).count() == 601
    runs.run(table(spark, first), lambda d: d.select("_topic", "_offset"))
    assert runs.output().count() == 601 and runs.pending(table(spark, first)).count() == 0
    second = [*first, (2, "a", 0, 300, 9), (2, "a", 0, 301, 1), (2, "c", 1, 0, 1)]

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        runs.run(table(spark, second), broken)
    assert runs.output().count() == 601
    runs.run(table(spark, second), lambda d: d.select("_topic", "_offset").distinct())
    assert rows(runs.output()) == [("a", 300), ("c", 0)]
    assert runs.pending(table(spark, second)).count() == 0

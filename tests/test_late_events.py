from datetime import UTC, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidewell.operators import late_events as L
from tidewell.streaming.stateful import PaneStore

H = L.HOUR_MS
REC = "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint"
TAB = "_file_id bigint, _topic string, _partition int, _offset bigint, _watermark timestamp_ntz, timestamp timestamp_ntz, money_spent decimal(18,6)"


def at(ms):
    return None if ms is None else datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


def tables(spark, recs, tabs=()):
    r = spark.createDataFrame([(t, p, o, ts, None, None, wm) for t, p, o, ts, wm in recs], REC)
    t = spark.createDataFrame([(f, t, p, o, at(wm), at(ts), None if m is None else Decimal(m)) for f, t, p, o, wm, ts, m in tabs], TAB)
    return r, t


def test_the_bound_is_inclusive_and_only_lower_offsets_count(spark):
    recs = [("a", 0, 1, 10 * H, 10 * H), ("a", 0, 2, 5 * H, 8 * H), ("a", 0, 3, 7 * H, 9 * H), ("a", 0, 4, 7 * H - 1, None), ("b", 0, 1, 0, 99 * H)]
    # watermark met at offsets 2.. is 10 h; 7 h .. 8 h ends at 8 h, plus 2 h = 10 h: after the cut-off
    assert rows(L.after_cutoff(*tables(spark, recs))) == [("a", 0, 2), ("a", 0, 3), ("a", 0, 4)]
    assert rows(L.after_cutoff(*tables(spark, [("a", 0, 1, 10 * H, 10 * H - 1), ("a", 0, 2, 7 * H, None)]))) == []


def test_lost_times_come_from_the_table_and_its_watermarks_count(spark):
    recs = [("a", 0, 5, -1, None), ("a", 0, 6, -1, -1), ("a", 0, 7, None, None)]
    tabs = [(1, "a", 0, 1, 20 * H, 20 * H, "1"), (1, "a", 0, 5, None, 3 * H, "2"), (2, "a", 0, 7, None, 2 * H, None)]
    assert rows(L.after_cutoff(*tables(spark, recs, tabs))) == [("a", 0, 5), ("a", 0, 7)]


def test_copies_count_once_and_nulls_and_extra_columns_do_no_harm(spark):
    recs = [("a", 0, 1, H, H)] * 3 + [(None, 0, 1, H, H), ("a", None, 1, H, H), ("a", 0, None, H, H)]
    r, t = tables(spark, recs, [(1, "a", 0, 1, None, H, "1.5"), (2, "a", 0, 1, None, H, "2.5"), (None, None, None, None, None, H, "9")])
    r = r.withColumn("stored", F.lit(1)).withColumn("__block", F.lit(2))
    t = t.withColumn("topic", F.lit("z")).withColumn("wm_ms", F.lit(-5))
    got = rows(L.hourly(r, t).select("topic", "records", "loaded", "money_spent", "out_of_order"))
    assert got == [("a", 1, 1, Decimal("2.500000"), 0)]


def test_empty_tables(spark):
    r, t = tables(spark, [])
    assert rows(L.after_cutoff(r, t)) == [] and rows(L.hourly(r, t)) == []


def test_a_late_record_changes_one_pane_and_re_emits_only_its_windows(spark):
    schema = "topic string, pane_ms bigint, records bigint, loaded bigint, money_spent decimal(38,6), out_of_order bigint"
    saved = spark.createDataFrame([("a", h * H, 10, 0, Decimal(h), 0) for h in range(6)], schema)
    late = spark.createDataFrame([("a", 2 * H, 1, 0, Decimal(5), 1)], schema)
    merged = L.merge_panes(saved, late)
    assert {r["pane_ms"] // H: r["records"] for r in merged.collect()} == {0: 10, 1: 10, 2: 11, 3: 10, 4: 10, 5: 10}
    windows = L.compose_windows(merged, 3, changed=late.select("topic", "pane_ms"))
    assert {r["window_start_ms"] // H: r["records"] for r in windows.collect()} == {0: 31, 1: 31, 2: 31}
    whole = {r["window_start_ms"] // H: r["records"] for r in L.compose_windows(merged, 3).collect()}
    assert whole == {-2: 10, -1: 20, 0: 31, 1: 31, 2: 31, 3: 30, 4: 20, 5: 10}


def test_pane_store_replays_a_batch_without_adding_it_twice(spark, tmp_path):
    schema = "topic string, pane_ms bigint, records bigint, loaded bigint, money_spent decimal(38,6), out_of_order bigint"
    delta = lambda h, n: spark.createDataFrame([("a", h * H, n, 0, Decimal(n), 0)], schema)
    store = PaneStore(spark, str(tmp_path / "panes"), panes_per_window=2)
    store.add(delta(0, 4), 0)
    store.add(delta(3, 5), 1)
    for _ in range(2):
        changed = store.add(delta(0, 1), 2)
        assert rows(changed.select("window_start_ms", "records")) == [(-H, 5), (0, 5)]
    assert rows(store.panes().select("pane_ms", "records")) == [(0, 5), (3 * H, 5)]


@pytest.mark.filterwarnings("ignore")
def test_hot_partition_across_many_blocks_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    recs = [("hot", 0, rnd.randrange(9000), rnd.randrange(60) * H // 2, rnd.choice([None, -1, rnd.randrange(60) * H // 2])) for _ in range(800)]
    recs = list({r[2]: r for r in recs}.values())
    want = set()
    for _, _, o, ts, _ in recs:
        met = max((w for _, _, p, _, w in recs if p < o and w is not None and w >= 0), default=None)
        if met is not None and (ts // H + 3) * H <= met:
            want.add(("hot", 0, o))
    assert set(rows(L.after_cutoff(*tables(spark, recs)))) == want


def _random_log(seed=3, n=240):
    import random

    rnd = random.Random(seed)
    recs, tabs = [], []
    for p in range(3):
        clock = 100 * H
        for o in range(n if p else 2 * n):
            clock += rnd.randrange(0, H // 3)
            ts = clock - rnd.choice([0, 0, 0, H // 2, 3 * H, 9 * H]) if rnd.random() > 0.1 else -1
            recs += [("a" if p < 2 else "b", p, o, ts, rnd.choice([clock, clock, None, -1]))] * rnd.choice([1, 1, 1, 2])
            if rnd.random() < 0.8:
                tabs += [(f, "a" if p < 2 else "b", p, o, rnd.choice([clock, None]), clock - H * rnd.randrange(4), str(rnd.randrange(9))) for f in range(rnd.choice([1, 1, 2]))]
    return recs, tabs


def test_closing_panes_judge_as_watermarks_met_do(spark):
    r, t = tables(spark, *_random_log())
    want = rows(L.judged(r, t).filter("polled and late").select("topic", "partition", "offset"))
    assert want and rows(L.after_cutoff(r, t)) == want


def test_the_log_in_batches_gives_the_panes_of_the_whole_log(spark, tmp_path):
    r, t = tables(spark, *_random_log(5))
    store = PaneStore(spark, str(tmp_path / "panes"), panes_per_window=2)
    for b in range(5):
        low, high = b * 100 - (30 if b else 0), (b + 1) * 100  # the end of the last batch is polled again
        part = r.filter(f"offset >= {low} and offset < {high}"), t.filter(f"_offset >= {low} and _offset < {high}")
        windows = rows(store.add_records(*part, b))
        assert windows and rows(store.add_records(*part, b)) == windows  # a replay
    cols = ["topic", "pane_ms", "records", "loaded", "money_spent", "out_of_order"]
    assert rows(store.panes().select(*cols)) == rows(L.panes(L.judged(r, t)).select(*cols))


def test_only_touched_panes_are_written_and_versions_are_folded(spark, tmp_path, monkeypatch):
    from tidewell.streaming import stateful

    monkeypatch.setattr(stateful, "MOST_VERSIONS", 3)
    schema = "topic string, pane_ms bigint, records bigint, loaded bigint, money_spent decimal(38,6), out_of_order bigint"
    delta = lambda hs: spark.createDataFrame([("a", h * H, 1, 0, Decimal(1), 0) for h in hs], schema)
    store = PaneStore(spark, str(tmp_path / "panes"))
    want = {}
    for b, hours in enumerate([range(9), [4], [2, 4], [20], [4], [0]]):
        store.add(delta(hours), b)
        for h in hours:
            want[h] = want.get(h, 0) + 1
        assert {r["pane_ms"] // H: r["records"] for r in store.panes().collect()} == want
        at = store._pointer()
        if b == 2:
            assert store._read(at["versions"][-1] + "/panes").count() == 2
    assert len(at["versions"]) == 3 and [n for n in store.folder.names() if n.startswith("v")] == at["versions"]

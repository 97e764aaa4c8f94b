"""Queries of the general data-preparation problems 1 to 5, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.encode import csv
from tidewell.model import struct
from tidewell.operators import changes, heavy_keys, intervals, late_events, small_files
from tidewell.session import load, lookup, ms_to_ntz, scratch, staged
from tidewell.streaming.stateful import PaneStore

ENTITY = ["_consumer_group", "_topic", "_partition"]
RECORD = ["_topic", "_partition"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.after_cutoff(load(spark, d, "stream_record"), load(spark, d, "test_table"))


def p1_hourly(spark: SparkSession, d: str) -> DataFrame:
    return late_events.hourly(load(spark, d, "stream_record"), load(spark, d, "test_table"))


#: Micro-batches in which p1_batches replays the log, and the share of one that is polled again with the next.
BATCHES = 4
AGAIN = 4


def p1_batches(spark: SparkSession, d: str) -> DataFrame:
    """The panes of p1_hourly, from the log in micro-batches: by offset, each polling the
    end of the one before again; late records correct panes that were emitted before."""
    rec, tab = load(spark, d, "stream_record"), load(spark, d, "test_table")
    width = (rec.select(F.col("offset").alias("o")).unionByName(tab.select(F.col("_offset").alias("o"))).agg(F.max("o")).first()[0] or 0) // BATCHES + 1
    with scratch(spark, "panes") as path:
        store = PaneStore(spark, path, panes_per_window=1)
        for b in range(BATCHES):
            inside = lambda c, b=b: (F.col(c) >= b * width - (width // AGAIN if b else 0)) & (F.col(c) < (b + 1) * width)
            store.add_records(rec.filter(inside("offset")), tab.filter(inside("_offset")), b)
        return staged(store.panes().select("topic", ms_to_ntz(F.col("pane_ms")).alias("hour"), "records", "loaded", "money_spent", "out_of_order"), "panes")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(load(spark, d, "file_offsets"), ENTITY, "_start_offset", "_end_offset")


def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods(load(spark, d, "file_offsets"), ENTITY, "_start_offset", "_end_offset")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return changes.to_process(load(spark, d, "test_table"), load(spark, d, "run_ledger"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_keys(_totals(spark, d), RECORD)


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).select(*RECORD, "records", "stored", F.col("newest").alias("newest_offset"), F.col("total").alias("money_spent"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.key_totals(load(spark, d, "test_table"), RECORD, "_offset", "_file_id", "money_spent")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the plan by which bytes are joined."""
    return small_files.plan(load(spark, d, "file_stats")).select("_file_id")


def p5_plan(spark: SparkSession, d: str) -> DataFrame:
    return small_files.plan(load(spark, d, "file_stats"))


def p5_regrouped(spark: SparkSession, d: str) -> DataFrame:
    return small_files.regroup(load(spark, d, "test_table"), load(spark, d, "file_stats")).withColumn("child_ids", F.array_join("child_ids", ";")).withColumn("width", F.col("width").cast("double"))


_LINE = struct("_topic string, _partition int, _offset bigint, id int, name string, timestamp timestamp_ntz, is_enabled boolean, child_ids array<int>, parent_id bigint, transaction_id string, money_spent decimal(18,6)")


def p5_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Small files of compressed lines, joined by their bytes; what the joined files hold when read back.

    The test tables have the files' rows only, so the files are written first,
    one zstandard frame each; joining reads and writes bytes."""
    t = load(spark, d, "test_table")
    moves = staged(small_files.plan(load(spark, d, "file_stats")), "moves")
    lines = t.join(lookup(moves.select("_file_id"), "small"), "_file_id", "left_semi").select("_file_id", csv.line(_LINE).alias("line")).withColumn("place", F.col("line"))
    with scratch(spark, "small_files") as path:
        frames = small_files.frames(lines).select(F.format_string("f%d.zst", "_file_id").alias("name"), F.col("frame").alias("content"))
        written = staged(small_files.write_files(frames, f"{path}/small"), "written")
        parts = moves.withColumn("path", F.format_string("f%d.zst", "_file_id")).join(written.withColumnRenamed("name", "path"), "path")
        parts = parts.select("directory", "target", "path", F.col("_file_id").alias("place"), "bytes", "crc")
        joined = staged(small_files.concat_files(parts, f"{path}/small", f"{path}/joined", "zstd"), "joined")
        return staged(small_files.contents(joined), "contents")


QUERIES = {f.__name__: f for f in (p1_found, p1_hourly, p1_batches, p2_found, p2_periods, p3_found, p4_found, p4_totals, p5_found, p5_plan, p5_regrouped, p5_concatenated)}

_P1 = """
WITH pts AS (
  SELECT topic, "partition", "offset", CASE WHEN watermark_ms >= 0 THEN watermark_ms END AS wm,
         CASE WHEN timestamp_ms >= 0 THEN timestamp_ms END AS ms, TRUE AS polled, NULL::BIGINT AS f, NULL::BIGINT AS tms, NULL::DECIMAL(18,6) AS money, FALSE AS loaded
  FROM stream_record
  UNION ALL
  SELECT _topic, _partition, _offset, epoch_us(_watermark) // 1000, NULL, FALSE, COALESCE(_file_id, -1), epoch_us("timestamp") // 1000, money_spent, TRUE
  FROM test_table),
rec AS (
  SELECT topic, "partition", "offset", MAX(wm) AS wm, MAX(ms) AS ms, BOOL_OR(polled) AS polled, BOOL_OR(loaded) AS loaded,
         MAX(CASE WHEN loaded THEN {'f': f, 'tms': tms, 'money': money} END) AS s
  FROM pts WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL),
met AS (
  SELECT *, COALESCE(ms, s.tms) AS event_ms,
         MAX(wm) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met_ms
  FROM rec),
judged AS (
  SELECT *, event_ms // 3600000 * 3600000 AS pane_ms, COALESCE(event_ms // 3600000 * 3600000 + 3600000 * 3 <= met_ms, FALSE) AS late
  FROM met WHERE event_ms IS NOT NULL)
"""

_LATEST = """
WITH files AS (
  SELECT _file_id, regexp_extract(arg_max(file_path, reported_at), '^(.*)/', 1) AS directory,
         arg_max(file_size, reported_at) FILTER (file_size IS NOT NULL) AS size, arg_max(COALESCE(records_written, -1), reported_at) AS records
  FROM file_stats WHERE _file_id IS NOT NULL AND file_path IS NOT NULL GROUP BY _file_id),
small AS (
  SELECT *, COUNT(*) OVER (PARTITION BY directory) AS n FROM files WHERE size < 16384 AND records > 0),
plan AS (
  SELECT directory, CAST(begins // 262144 AS BIGINT) AS target, _file_id, size, records, CAST(begins AS BIGINT) AS begins FROM (
    SELECT *, COALESCE(SUM(size) OVER (PARTITION BY directory ORDER BY _file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
    FROM small WHERE n > 1))
"""

_COVER = """
WITH ok AS (SELECT DISTINCT _consumer_group, _topic, _partition, _start_offset AS s, _end_offset AS e FROM file_offsets WHERE _end_offset >= _start_offset),
prev AS (
  SELECT *, MAX(e) OVER (PARTITION BY _consumer_group, _topic, _partition ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM ok)
"""

_HOURLY = _P1 + """
SELECT topic, make_timestamp(pane_ms * 1000) AS hour, COUNT(*) AS records, CAST(SUM(loaded::INT) AS BIGINT) AS loaded,
       CAST(COALESCE(SUM(s.money), 0) AS DECIMAL(38,6)) AS money_spent, CAST(COALESCE(SUM((met_ms > event_ms)::INT), 0) AS BIGINT) AS out_of_order
FROM judged WHERE NOT late GROUP BY topic, pane_ms"""

SQL = {
    "p1_found": _P1 + 'SELECT topic, "partition", "offset" FROM judged WHERE polled AND late',
    "p1_hourly": _HOURLY,
    "p1_batches": _HOURLY,
    "p2_found": _COVER + "SELECT _consumer_group, _topic, _partition, p + 1 AS gap_start, s - 1 AS gap_end FROM prev WHERE s > p + 1",
    "p2_periods": _COVER + """, isl AS (
  SELECT *, SUM(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY _consumer_group, _topic, _partition ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM prev)
SELECT _consumer_group, _topic, _partition, MIN(s) AS period_start, MAX(e) AS period_end FROM isl GROUP BY _consumer_group, _topic, _partition, i""",
    "p3_found": """
WITH att AS (
  SELECT run_id, attempt, arg_max(run_state, logged_at) AS st, arg_max(_topic, logged_at) AS t, arg_max(_partition, logged_at) AS p,
         arg_max(_start_offset, logged_at) AS s, arg_max(_end_offset, logged_at) AS e, arg_max(_max_file_id, logged_at) AS seen
  FROM run_ledger GROUP BY run_id, attempt),
rows_ AS (
  SELECT _topic, _partition, _offset, _file_id, {'a': id, 'b': name, 'c': "timestamp", 'd': height, 'e': width, 'f': is_enabled, 'g': child_ids, 'h': parent_id, 'i': transaction_id, 'j': money_spent} AS content
  FROM test_table WHERE _topic IS NOT NULL AND _partition IS NOT NULL AND _offset IS NOT NULL),
keys AS (SELECT DISTINCT _topic, _partition, _offset FROM rows_),
f AS (
  SELECT k.*, MAX(a.seen) AS seen FROM keys k LEFT JOIN att a ON a.st = 'committed' AND a.t = k._topic AND a.p = k._partition AND k._offset BETWEEN a.s AND a.e
  GROUP BY k._topic, k._partition, k._offset),
c AS (
  SELECT f._topic, f._partition, f._offset, f.seen, arg_max(r.content, COALESCE(r._file_id, -1)) AS cur,
         arg_max(r.content, r._file_id) FILTER (r._file_id <= f.seen) AS old, COUNT(*) FILTER (r._file_id <= f.seen) AS n
  FROM f JOIN rows_ r USING (_topic, _partition, _offset) GROUP BY ALL)
SELECT _topic, _partition, _offset FROM c WHERE seen IS NULL OR n = 0 OR cur IS DISTINCT FROM old""",
    "p4_found": """
WITH k AS (SELECT _topic, _partition, COUNT(DISTINCT _offset) AS n FROM test_table WHERE _topic IS NOT NULL AND _partition IS NOT NULL AND _offset IS NOT NULL GROUP BY 1, 2)
SELECT _topic, _partition FROM k WHERE n * 25 >= (SELECT SUM(n) FROM k)""",
    "p4_totals": """
WITH r AS (
  SELECT _topic, _partition, _offset, COUNT(*) AS stored, arg_max(money_spent, COALESCE(_file_id, -1)) AS money FROM test_table
  WHERE _topic IS NOT NULL AND _partition IS NOT NULL AND _offset IS NOT NULL GROUP BY 1, 2, 3)
SELECT _topic, _partition, COUNT(*) AS records, CAST(SUM(stored) AS BIGINT) AS stored, MAX(_offset) AS newest_offset, CAST(SUM(money) AS DECIMAL(38,6)) AS money_spent
FROM r GROUP BY 1, 2""",
    "p5_found": _LATEST + "SELECT _file_id FROM small WHERE n > 1",
    "p5_plan": _LATEST + "SELECT directory, target, _file_id, size, records, begins FROM plan",
    "p5_regrouped": _LATEST + "SELECT t.* REPLACE (array_to_string(t.child_ids, ';') AS child_ids, CAST(t.width AS DOUBLE) AS width), plan.directory, plan.target FROM test_table t LEFT JOIN plan USING (_file_id)",
    "p5_concatenated": _LATEST + """, lines AS (
  SELECT plan.directory, plan.target, _file_id, concat_ws(chr(9), COALESCE(_topic, ''), COALESCE(_partition::VARCHAR, ''), COALESCE(_offset::VARCHAR, ''), COALESCE(id::VARCHAR, ''), COALESCE(name, ''),
    COALESCE(strftime(make_timestamp(epoch_us("timestamp") // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g'), ''), COALESCE(is_enabled::VARCHAR, ''), COALESCE(array_to_string(child_ids, ';'), ''), COALESCE(parent_id::VARCHAR, ''), COALESCE(transaction_id, ''),
    COALESCE(money_spent::VARCHAR, '')) || chr(10) AS line FROM test_table JOIN plan USING (_file_id))
SELECT directory, target, COUNT(DISTINCT _file_id) AS files, COUNT(*) AS lines, md5(string_agg(line, '' ORDER BY _file_id, line)) AS content FROM lines GROUP BY directory, target""",
}

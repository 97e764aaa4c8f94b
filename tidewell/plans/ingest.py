"""Queries of the ingest operators over the log, the loaded table and its offsets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.commit import metadata
from tidewell.encode import binary, csv, native, rowbinary
from tidewell.model import KEYS, RECORD, OffsetInterval, WatermarkInterval, format_ms, struct
from tidewell.operators import commit_strategy, formatting, positions, ranges, rewind, routing, watermark
from tidewell.operators.commit_strategy import AnyOf
from tidewell.operators.late_events import HOUR_MS
from tidewell.session import epoch_ms, load, lookup, scratch, staged
from tidewell.sources import files
from tidewell.sources import log as logs
from tidewell.streaming import stateful

#: The clock of the watermark queries, and the time looked up in the log.
NOW_MS = 1_672_900_000_000
AT_MS = 1_672_728_267_101
GROUP = "loader_main"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "value"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    return watermark.with_watermark(_log(spark, d), NOW_MS)


def _partitions(spark: SparkSession, d: str, group: str) -> DataFrame:
    f = load(spark, d, "file_offsets").filter(F.col("_consumer_group") == group)
    return f.select(F.col("_topic").alias("topic"), F.col("_partition").alias("partition")).distinct()


def _file_ranges(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "file_offsets").filter("_end_offset >= _start_offset").distinct()
    return f.select(
        "_consumer_group", "_file_id", F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("_start_offset").alias("start_offset"), F.col("_end_offset").alias("end_offset"),
        epoch_ms(F.col("_end_watermark")).alias("end_watermark_ms"),
    )


def log_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = logs.scan(load(spark, d, "stream_record"))
    return rows.select(*KEYS, "offset", "timestamp_ms", F.hex("key").alias("key"), F.hex("value").alias("value"), "watermark_ms")


def log_scan_pattern(spark: SparkSession, d: str) -> DataFrame:
    return logs.topic_pattern(_log(spark, d), "(meter|parcel)_.*")


def running_watermark(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


def seeded_watermark(spark: SparkSession, d: str) -> DataFrame:
    seeds = lookup(positions.external(load(spark, d, "file_offsets"), GROUP).select(*KEYS, F.col("watermark_ms").alias("seed_ms")), "seeds")
    return watermark.with_watermark(_log(spark, d), NOW_MS, seeds=seeds).select(*KEYS, "offset", "watermark_ms")


def late_records(spark: SparkSession, d: str) -> DataFrame:
    late = (F.col("timestamp_ms") >= 0) & (F.col("timestamp_ms") < F.col("watermark_ms"))
    return _marked(spark, d).groupBy(*KEYS).agg(F.count(F.when(late, 1)).alias("late"), F.count(F.lit(1)).alias("records"))


def future_rejected(spark: SparkSession, d: str) -> DataFrame:
    ahead = F.col("timestamp_ms") > NOW_MS + watermark.SKEW_MS
    return _log(spark, d).groupBy(*KEYS).agg(F.count(F.when(ahead, 1)).alias("rejected"))


def _batched(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).withColumn("batch", F.expr("offset div 100"))


def stream_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ranges.build(_batched(spark, d), ["batch"])


def range_merge(spark: SparkSession, d: str) -> DataFrame:
    b = _batched(spark, d)
    return ranges.merge(ranges.build(b.filter("batch % 2 = 0")), ranges.build(b.filter("batch % 2 = 1")))


def positions_in_row(spark: SparkSession, d: str) -> DataFrame:
    return positions.in_row(load(spark, d, "test_table"))


def positions_external(spark: SparkSession, d: str) -> DataFrame:
    return positions.external(load(spark, d, "file_offsets"), GROUP)


def positions_requested(spark: SparkSession, d: str) -> DataFrame:
    asked = _partitions(spark, d, "loader_backfill").unionByName(spark.createDataFrame([("nowhere", 0), ("bike_dock", 999)], "topic string, partition int"))
    return positions.requested(asked, positions.external(load(spark, d, "file_offsets"), GROUP))


def batch_committed(spark: SparkSession, d: str) -> DataFrame:
    batches = _file_ranges(spark, d).withColumn("batch", F.expr("_file_id div 4"))
    return positions.committed(batches, positions.external(load(spark, d, "file_offsets"), "loader_audit"), "batch")


def offsets_for_times(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return logs.offsets_for_times(log, log.select(*KEYS).distinct().withColumn("target_ms", F.lit(AT_MS)))


def rewind_offset(spark: SparkSession, d: str) -> DataFrame:
    return rewind.rewind(positions_in_row(spark, d), _log(spark, d), OffsetInterval(100))


def rewind_watermark(spark: SparkSession, d: str) -> DataFrame:
    return rewind.rewind(positions_in_row(spark, d), _log(spark, d), WatermarkInterval(12 * HOUR_MS))


def rewind_split(spark: SparkSession, d: str) -> DataFrame:
    rows = rewind.split(_log(spark, d), positions.external(load(spark, d, "file_offsets"), "loader_audit"))
    return rows.groupBy(*KEYS).agg(F.count(F.when(F.col("rewound"), 1)).alias("touched"), F.count(F.when(~F.col("rewound"), 1)).alias("written"))


def group_routing(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(_log(spark, d), routing.modulo_group(2)).groupBy("group_name").agg(F.count(F.lit(1)).alias("records"))


def assign_revoke(spark: SparkSession, d: str) -> DataFrame:
    group = routing.modulo_group(2)
    assigned = routing.assign(_partitions(spark, d, "loader_audit"), _partitions(spark, d, GROUP), group)
    return routing.revoke(assigned, _partitions(spark, d, "loader_backfill"), group)


def format_flatmap(spark: SparkSession, d: str) -> DataFrame:
    rows = formatting.flat_map(formatting.payload_fields(F.col("value")), "field")(_payloads(spark, d))
    return rows.select(*KEYS, "offset", "field")


def _survivors(records: DataFrame) -> DataFrame:
    return formatting.filtering("value is not null and partition % 2 = 0")(records)


def ranges_prefilter(spark: SparkSession, d: str) -> DataFrame:
    rows = _payloads(spark, d).withColumn("batch", F.expr("offset div 100"))
    spans = rows.groupBy("batch", *KEYS).agg(F.min("offset").alias("start_offset"), F.max("offset").alias("end_offset"))
    kept = _survivors(rows).groupBy("batch", *KEYS).agg(F.count(F.lit(1)).alias("written"))
    return spans.join(kept, ["batch", *KEYS], "left").withColumn("written", F.coalesce("written", F.lit(0)).cast("bigint"))


def records_written_vs_batched(spark: SparkSession, d: str) -> DataFrame:
    return formatting.written_and_batched(_payloads(spark, d), formatting.flat_map(formatting.payload_fields(F.col("value")), "field"))


def partition_by_date(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "test_table")
    return t.groupBy(formatting.date_path(F.col("timestamp")).alias("path")).agg(F.count(F.lit(1)).alias("records"), F.min("_offset").alias("start_offset"), F.max("_offset").alias("end_offset"))


def cut_by_count(spark: SparkSession, d: str) -> DataFrame:
    return commit_strategy.cut_by_count(_log(spark, d), ["topic"], 500).select(*KEYS, "offset", "batch")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "file_stats").distinct()
    return s.select(F.regexp_extract("file_path", "^(.*)/", 1).alias("directory"), F.col("file_open_duration_ms").alias("open_ms"), F.col("file_size").alias("size"), F.col("records_written").alias("records"))


_LIMIT = AnyOf(open_ms=25_000, size=60_000, records=40)


def commit_any(spark: SparkSession, d: str) -> DataFrame:
    return commit_strategy.any_file(_stats(spark, d), ["directory"], _LIMIT)


def commit_all(spark: SparkSession, d: str) -> DataFrame:
    return commit_strategy.all_files(_stats(spark, d), ["directory"], _LIMIT)


def commit_total(spark: SparkSession, d: str) -> DataFrame:
    return commit_strategy.total(_stats(spark, d), ["directory"], AnyOf(size=400_000, records=300))


def transform_truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").groupBy(formatting.truncate(F.col("name"), 1).alias("name_trunc"), formatting.truncate_int(F.col("_offset"), 1000).alias("offset_trunc")).agg(F.count(F.lit(1)).alias("records"))


def file_offsets_left_join(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "file_offsets").filter(F.col("_consumer_group") == GROUP).groupBy("_file_id").agg(F.min("_start_offset").alias("start_offset"), F.max("_end_offset").alias("end_offset"))
    t = load(spark, d, "test_table").select("_file_id", "_topic", "_partition", "_offset", "id")
    return t.join(f, "_file_id", "left")


def dedup_token(spark: SparkSession, d: str) -> DataFrame:
    return ranges.dedup_token(_file_ranges(spark, d).withColumn("batch", F.expr("_file_id div 8")), ["batch"])


def offset_property(spark: SparkSession, d: str) -> DataFrame:
    p = positions.external(load(spark, d, "file_offsets"), GROUP)
    text = metadata.property_value(F.col("offset") - 1, F.coalesce("watermark_ms", F.lit(0)))
    rows = p.select(*KEYS, text.alias("property"))
    return rows.withColumn("p", metadata.property_position(F.col("property"))).select(*KEYS, "property", "p.offset", "p.watermark_ms")


def timestamp_format(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("timestamp_ms")
    return _log(spark, d).select(*KEYS, "offset", format_ms(ts, csv.TIMESTAMP).alias("text"), format_ms(ts, "'dt='yyyyMMdd").alias("path"))


_CSV = struct("_topic string, _partition int, _offset bigint, id int, name string, timestamp timestamp_ntz, is_enabled boolean, child_ids array<int>, parent_id bigint, money_spent decimal(18,6), transaction_id string")


def csv_line(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select("_file_id", csv.line(_CSV).alias("line"))


def le_int(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select(
        "_file_id", "_offset", "id", F.hex(binary.le_int(F.col("_partition"), 2)).alias("le16"), F.hex(binary.le_int(F.col("id"), 4)).alias("le32"), F.hex(binary.le_int(F.col("parent_id"), 8)).alias("le64")
    )


def leb128_length(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.hex(binary.leb128(F.octet_length("text"))).alias("length"))


def fixed_string(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.fixed_utf8(F.col("name"), 12)).alias("fixed"))


def max_string(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.cut_utf8(F.col("name"), 9)).alias("cut"))


def utf8_truncate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.hex(binary.cut_utf8(F.col("text"), 120)).alias("cut"))


def decimal_scaled(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("money_spent")
    return load(spark, d, "test_table").select("_file_id", "id", binary.scaled_int(m, 2).alias("scaled"), F.hex(binary.decimal(m, 18, 2)).alias("bytes"))


def decimal_wide(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.decimal(F.col("money_spent"), 20, 6)).alias("bytes"))


def float_bytes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.le_float64(F.col("height"))).alias("le64"), F.hex(binary.le_float32(F.col("width"))).alias("le32"))


def native_time(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("timestamp").cast("timestamp")
    return load(spark, d, "test_table").select(
        "_file_id", "id", F.hex(binary.le_int(F.unix_micros(ts) - binary.NATIVE_EPOCH_US, 8)).alias("micros"), F.hex(binary.le_int(F.unix_date(ts.cast("date")) - binary.NATIVE_EPOCH_DAYS, 8)).alias("days")
    )


def rowbinary_time(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("timestamp").cast("timestamp")
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.le_int(F.unix_seconds(ts), 4)).alias("seconds"), F.hex(binary.le_int(F.unix_date(ts.cast("date")), 2)).alias("days"))


_RB = T.StructType([
    T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), True), T.StructField("is_enabled", T.BooleanType(), False),
    T.StructField("child_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("parent_id", T.LongType(), True), T.StructField("money_spent", T.DecimalType(18, 6), False),
    T.StructField("timestamp", T.TimestampNTZType(), False), T.StructField("height", T.DoubleType(), False), T.StructField("width", T.FloatType(), False),
    T.StructField("transaction_id", T.StringType(), False, {"uuid": True}), T.StructField("widths", T.ArrayType(T.FloatType(), False), False),
])
_NATIVE = T.StructType([f for f in _RB.fields if f.name not in ("child_ids", "widths")])


def rowbinary_row(spark: SparkSession, d: str) -> DataFrame:
    return rowbinary.encode(load(spark, d, "test_table").withColumn("widths", F.array("width", "width")), _RB).select("_file_id", F.hex("row").alias("row"))


def native_row(spark: SparkSession, d: str) -> DataFrame:
    return native.encode(load(spark, d, "test_table"), _NATIVE).select("_file_id", F.hex("row").alias("row"))


def two_phase_positions(spark: SparkSession, d: str) -> DataFrame:
    r = _file_ranges(spark, d).filter(F.col("_consumer_group") == GROUP)
    last = r.groupBy(*KEYS).agg(F.max(F.struct("_file_id", "end_offset", "end_watermark_ms")).alias("l"))
    text = last.select(*KEYS, (F.col("l.end_offset") + 1).alias("offset"), metadata.json_column(F.col("l.end_watermark_ms")).alias("metadata"))
    return text.select(*KEYS, "offset", F.coalesce(metadata.parsed(F.col("metadata"))["watermark"], F.lit(0).cast("bigint")).alias("watermark_ms"))


def multiset_readback(spark: SparkSession, d: str) -> DataFrame:
    """Written by date and topic to files and read back: what is there, how often."""
    t = load(spark, d, "test_table").withColumn("day", formatting.utc_date(F.col("timestamp")))
    with scratch(spark, "readback") as path:
        # rows of a day come together: not every task writes a file in every folder
        t.hint("rebalance", "day").write.options(**files.ParquetConfig().options()).partitionBy("day").parquet(path)
        back = spark.read.parquet(path)
        kinds = [F.count_distinct(c).alias(c) for c in ("height", "width", "transaction_id")]
        counted = back.groupBy("day", "_topic").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("id").alias("ids"), F.sum("money_spent").cast("decimal(38,6)").alias("money_spent"), *kinds)
        return staged(counted, "readback")


def stateful_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The running watermark by state that micro-batches carry on; each record's row is written once."""
    load(spark, d, "stream_record")  # the session's time zone
    with scratch(spark, "stateful") as path:
        marked = stateful.MarkedLog(spark, f"{path}/marked", NOW_MS)
        query = spark.readStream.schema(RECORD).parquet(f"{d}/stream_record.parquet*").writeStream.foreachBatch(marked.process)
        query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return staged(marked.read(), "marked")


def file_paths(spark: SparkSession, d: str) -> DataFrame:
    """Where a day's records of each partition parity go: paths that are a function of day and ranges."""
    rows = _marked(spark, d).filter("timestamp_ms >= 0").withColumn("day", F.timestamp_millis("timestamp_ms").cast("date")).withColumn("part", F.col("partition") % 2)
    each = ranges.by_file(rows, ["day", "part"])
    names = F.transform("ranges", lambda r: F.struct(r["topic"].alias("topic"), r["partition"].alias("partition"), r["start_offset"].alias("start_offset"), r["end_offset"].alias("end_offset")))
    return each.select("day", "part", files.TimePaths(extension="zst").column(F.col("day"), names).alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        log_scan, log_scan_pattern, running_watermark, seeded_watermark, late_records, future_rejected, stream_ranges, range_merge, positions_in_row, positions_external, positions_requested,
        batch_committed, offsets_for_times, rewind_offset, rewind_watermark, rewind_split, group_routing, assign_revoke, format_flatmap, ranges_prefilter, records_written_vs_batched,
        partition_by_date, cut_by_count, commit_any, commit_all, commit_total, transform_truncate, file_offsets_left_join, dedup_token, offset_property, timestamp_format, csv_line, le_int,
        leb128_length, fixed_string, max_string, utf8_truncate, decimal_scaled, decimal_wide, float_bytes, native_time, rowbinary_time, rowbinary_row, native_row, two_phase_positions,
        multiset_readback, stateful_watermark, file_paths,
    )
}

_L = """
WITH log AS (SELECT topic, "partition", "offset", MAX(timestamp_ms) AS timestamp_ms FROM stream_record
  WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL)
"""
_W = _L + f""", w AS (SELECT *, GREATEST(-1, COALESCE(MAX(CASE WHEN timestamp_ms <= {NOW_MS + watermark.SKEW_MS} THEN timestamp_ms END)
  OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING), -1)) AS watermark_ms FROM log)
"""
_V = """
WITH pay AS (SELECT topic, "partition", "offset", MAX(value) AS value FROM stream_record
  WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL)
"""
_ROW = """
WITH pos AS (SELECT _topic AS topic, _partition AS "partition", MAX(_offset) + 1 AS "offset", MAX(epoch_us(_watermark) // 1000) AS watermark_ms FROM test_table
  WHERE _topic IS NOT NULL AND _partition IS NOT NULL GROUP BY ALL)
"""


def _ext(group: str, name: str = "pos") -> str:
    return f"""{name} AS (SELECT _topic AS topic, _partition AS "partition", MAX(_end_offset) + 1 AS "offset", MAX(epoch_us(_end_watermark) // 1000) AS watermark_ms
  FROM file_offsets WHERE _consumer_group = '{group}' GROUP BY ALL)"""


_FR = """fr AS (SELECT DISTINCT _consumer_group, _file_id, _topic AS topic, _partition AS "partition", _start_offset AS start_offset, _end_offset AS end_offset, _end_watermark FROM file_offsets WHERE _end_offset >= _start_offset)"""
_RANGE = """MIN("offset") AS start_offset, ARG_MIN(watermark_ms, "offset") AS start_watermark_ms, MAX("offset") AS end_offset, MAX(watermark_ms) AS end_watermark_ms"""
_ST = """WITH st AS (SELECT regexp_extract(file_path, '^(.*)/', 1) AS directory, file_open_duration_ms AS open_ms, file_size AS size, records_written AS records FROM (SELECT DISTINCT * FROM file_stats))"""
_HIT = "COALESCE(open_ms >= 25000 OR size >= 60000 OR records >= 40, FALSE)"


def _le(x: str, n: int) -> str:
    return f"array_to_string(list_transform(range(0, {n}), lambda i: lpad(upper(to_hex((CAST({x} AS BIGINT) >> CAST(i * 8 AS INT)) & 255)), 2, '0')), '')"


def _varint(x: str) -> str:
    h = lambda e: f"lpad(upper(to_hex(CAST({e} AS BIGINT))), 2, '0')"
    return f"""CASE WHEN {x} < 128 THEN {h(x)} WHEN {x} < 16384 THEN {h(f'({x} & 127) | 128')} || {h(f'{x} >> 7')}
      WHEN {x} < 2097152 THEN {h(f'({x} & 127) | 128')} || {h(f'(({x} >> 7) & 127) | 128')} || {h(f'{x} >> 14')}
      ELSE {h(f'({x} & 127) | 128')} || {h(f'(({x} >> 7) & 127) | 128')} || {h(f'(({x} >> 14) & 127) | 128')} || {h(f'{x} >> 21')} END"""


def _cut(column: str, most: int) -> str:
    h = f"hex(encode({column}))"
    inner = "0"
    for k in range(most - 3, most + 1):
        inner = f"CASE WHEN substr({h}, {2 * k + 1}, 2) NOT BETWEEN '80' AND 'BF' THEN {k} ELSE {inner} END"
    return f"CASE WHEN strlen({column}) <= {most} THEN {h} ELSE substr({h}, 1, 2 * ({inner})) END"


_US = 'epoch_us("timestamp")'


def float_le(column: str, kind: str) -> str:
    """A float's bytes in hex, little endian."""
    h, n = f"hex(CAST(CAST({column} AS BIT) AS BLOB))", 8 if kind == "DOUBLE" else 4
    return " || ".join(f"substr({h}, {2 * i - 1}, 2)" for i in range(n, 0, -1))


_UUID = "upper(replace(transaction_id, '-', ''))"


def _turned(a: int, b: int) -> str:
    return " || ".join(f"substr({_UUID}, {2 * i - 1}, 2)" for i in range(b, a - 1, -1))


_UUID_HALVES = f"{_turned(1, 8)} || {_turned(9, 16)}"
_WIDTH = "CAST(width AS DOUBLE)"
_HEIGHT_LE, _WIDTH_LE, _WIDE_LE = float_le("height", "DOUBLE"), float_le("width", "FLOAT"), float_le(_WIDTH, "DOUBLE")
_SQL_NATIVE = f"""{_le('id', 4)} || {_le('strlen(name)', 4)} || hex(encode(name)) || {_le('is_enabled::INT', 1)} || COALESCE({_le('parent_id', 8)}, '') || {_le('CAST(money_spent * 1000000 AS BIGINT)', 8)} || {_le(f'({_US} - 946684800000000)', 8)} || {_HEIGHT_LE} || {_WIDE_LE} || {_UUID}"""

SQL = {
    "log_scan": """SELECT topic, "partition", "offset", MAX(timestamp_ms) AS timestamp_ms, hex(MAX(key)) AS key, hex(MAX(value)) AS value, MAX(watermark_ms) AS watermark_ms FROM stream_record
      WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL""",
    "log_scan_pattern": _L + "SELECT * FROM log WHERE regexp_matches(topic, '^(meter|parcel)_')",
    "running_watermark": _W + "SELECT * FROM w",
    "seeded_watermark": _W + f""", {_ext(GROUP)} SELECT w.topic, w."partition", w."offset", GREATEST(COALESCE(pos.watermark_ms, -1), w.watermark_ms) AS watermark_ms
      FROM w LEFT JOIN pos ON pos.topic = w.topic AND pos."partition" = w."partition\"""",
    "late_records": _W + """SELECT topic, "partition", COUNT(*) FILTER (timestamp_ms >= 0 AND timestamp_ms < watermark_ms) AS late, COUNT(*) AS records FROM w GROUP BY topic, "partition\"""",
    "future_rejected": _L + f"""SELECT topic, "partition", COUNT(*) FILTER (timestamp_ms > {NOW_MS + watermark.SKEW_MS}) AS rejected FROM log GROUP BY topic, "partition\"""",
    "stream_ranges": _W + f"""SELECT "offset" // 100 AS batch, topic, "partition", {_RANGE} FROM w GROUP BY 1, 2, 3""",
    "range_merge": _W + f""", r AS (SELECT ("offset" // 100) % 2 AS side, topic, "partition", {_RANGE} FROM w GROUP BY 1, 2, 3),
      a AS (SELECT * FROM r WHERE side = 0), b AS (SELECT * FROM r WHERE side = 1)
      SELECT COALESCE(a.topic, b.topic) AS topic, COALESCE(a."partition", b."partition") AS "partition", COALESCE(a.start_offset, b.start_offset) AS start_offset,
        COALESCE(a.start_watermark_ms, b.start_watermark_ms) AS start_watermark_ms, COALESCE(b.end_offset, a.end_offset) AS end_offset, COALESCE(b.end_watermark_ms, a.end_watermark_ms) AS end_watermark_ms
      FROM a FULL JOIN b ON a.topic = b.topic AND a."partition" = b."partition\"""",
    "positions_in_row": _ROW + "SELECT * FROM pos",
    "positions_external": f"WITH {_ext(GROUP)} SELECT * FROM pos",
    "positions_requested": f"""WITH {_ext(GROUP)}, asked AS (SELECT DISTINCT _topic AS topic, _partition AS "partition" FROM file_offsets WHERE _consumer_group = 'loader_backfill'
      UNION ALL SELECT 'nowhere', 0 UNION ALL SELECT 'bike_dock', 999) SELECT topic, "partition", "offset", watermark_ms FROM asked LEFT JOIN pos USING (topic, "partition")""",
    "batch_committed": f"""WITH {_ext('loader_audit')}, {_FR} SELECT _file_id // 4 AS batch, BOOL_AND(COALESCE(pos."offset" > end_offset, FALSE)) AS committed FROM fr LEFT JOIN pos USING (topic, "partition") GROUP BY 1""",
    "offsets_for_times": _L + f"""SELECT topic, "partition", CAST({AT_MS} AS BIGINT) AS target_ms, MIN("offset") FILTER (timestamp_ms >= {AT_MS}) AS "offset",
      ARG_MIN(timestamp_ms, "offset") FILTER (timestamp_ms >= {AT_MS}) AS timestamp_ms FROM log GROUP BY topic, "partition\"""",
    "rewind_offset": _ROW + """SELECT topic, "partition", GREATEST(0, "offset" - 100) AS "offset", watermark_ms FROM pos""",
    "rewind_watermark": _L + ", " + _ROW.replace("WITH", "").strip() + f""" SELECT pos.topic, pos."partition", MIN(log."offset") AS "offset", ARG_MIN(log.timestamp_ms, log."offset") AS watermark_ms
      FROM pos LEFT JOIN log ON log.topic = pos.topic AND log."partition" = pos."partition" AND pos.watermark_ms > 0 AND log.timestamp_ms >= GREATEST(0, pos.watermark_ms - {12 * HOUR_MS}) GROUP BY 1, 2""",
    "rewind_split": _L + f""", {_ext('loader_audit')}, s AS (SELECT log.*, COALESCE(BOOL_OR(log."offset" >= pos."offset") OVER (PARTITION BY log.topic, log."partition" ORDER BY log."offset" ROWS UNBOUNDED PRECEDING), TRUE) AS done
      FROM log LEFT JOIN pos ON pos.topic = log.topic AND pos."partition" = log."partition")
      SELECT topic, "partition", COUNT(*) FILTER (NOT done) AS touched, COUNT(*) FILTER (done) AS written FROM s GROUP BY 1, 2""",
    "group_routing": _L + """SELECT 'partition_' || ("partition" % 2) AS group_name, COUNT(*) AS records FROM log GROUP BY 1""",
    "assign_revoke": """WITH p AS (SELECT DISTINCT _consumer_group AS g, _topic AS topic, _partition AS "partition" FROM file_offsets),
      a AS (SELECT topic, "partition" FROM p WHERE g IN ('loader_audit', 'loader_main') GROUP BY ALL)
      SELECT topic, "partition", 'partition_' || ("partition" % 2) AS group_name FROM a WHERE (topic, "partition") NOT IN (SELECT (topic, "partition") FROM p WHERE g = 'loader_backfill')""",
    "format_flatmap": _V + """SELECT topic, "partition", "offset", UNNEST(string_split(decode(value), ';')) AS field FROM pay WHERE value IS NOT NULL""",
    "ranges_prefilter": _V + """SELECT "offset" // 100 AS batch, topic, "partition", MIN("offset") AS start_offset, MAX("offset") AS end_offset, COUNT(*) FILTER (value IS NOT NULL AND "partition" % 2 = 0) AS written FROM pay GROUP BY 1, 2, 3""",
    "records_written_vs_batched": _V + """SELECT topic, "partition", COUNT(*) AS batched, CAST(COALESCE(SUM(len(string_split(decode(value), ';'))), 0) AS BIGINT) AS written FROM pay GROUP BY 1, 2""",
    "partition_by_date": """SELECT strftime("timestamp", 'dt=%Y%m%d') AS path, COUNT(*) AS records, MIN(_offset) AS start_offset, MAX(_offset) AS end_offset FROM test_table GROUP BY 1""",
    "cut_by_count": _L + """SELECT topic, "partition", "offset", (ROW_NUMBER() OVER (PARTITION BY topic ORDER BY timestamp_ms, topic, "partition", "offset") - 1) // 500 AS batch FROM log""",
    "commit_any": _ST + f"SELECT directory, BOOL_OR({_HIT}) AS ready FROM st GROUP BY 1",
    "commit_all": _ST + f"SELECT directory, BOOL_AND({_HIT}) AS ready FROM st GROUP BY 1",
    "commit_total": _ST + """SELECT directory, MAX(open_ms) AS open_ms, CAST(SUM(size) AS BIGINT) AS size, CAST(SUM(records) AS BIGINT) AS records, COALESCE(SUM(size) >= 400000 OR SUM(records) >= 300, FALSE) AS ready FROM st GROUP BY 1""",
    "transform_truncate": "SELECT substr(name, 1, 1) AS name_trunc, _offset - _offset % 1000 AS offset_trunc, COUNT(*) AS records FROM test_table GROUP BY 1, 2",
    "file_offsets_left_join": f"""WITH f AS (SELECT _file_id, MIN(_start_offset) AS start_offset, MAX(_end_offset) AS end_offset FROM file_offsets WHERE _consumer_group = '{GROUP}' GROUP BY 1)
      SELECT t._file_id, t._topic, t._partition, t._offset, t.id, f.start_offset, f.end_offset FROM test_table t LEFT JOIN f ON f._file_id = t._file_id""",
    "dedup_token": f"""WITH {_FR}, t AS (SELECT DISTINCT _file_id // 8 AS batch, concat_ws(':', topic, "partition", start_offset, end_offset) AS t FROM fr) SELECT batch, string_agg(t, ';' ORDER BY t) AS token FROM t GROUP BY 1""",
    "offset_property": f"""WITH {_ext(GROUP)} SELECT topic, "partition", ("offset" - 1) || ':' || COALESCE(watermark_ms, 0) AS property, "offset", COALESCE(watermark_ms, 0) AS watermark_ms FROM pos""",
    "timestamp_format": _L + """SELECT topic, "partition", "offset", CASE WHEN timestamp_ms >= 0 THEN strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S.%g') END AS text,
      CASE WHEN timestamp_ms >= 0 THEN strftime(make_timestamp(timestamp_ms * 1000), 'dt=%Y%m%d') END AS path FROM log""",
    "csv_line": f"""SELECT _file_id, concat(COALESCE(_topic, ''), chr(9), COALESCE(_partition::VARCHAR, ''), chr(9), COALESCE(_offset::VARCHAR, ''), chr(9), COALESCE(id::VARCHAR, ''), chr(9), COALESCE(name, ''), chr(9),
      strftime(make_timestamp({_US} // 1000 * 1000), '%Y-%m-%d %H:%M:%S.%g'), chr(9), is_enabled::VARCHAR, chr(9), array_to_string(child_ids, ';'), chr(9), COALESCE(parent_id::VARCHAR, ''), chr(9), money_spent::VARCHAR, chr(9), COALESCE(transaction_id, '')) AS line FROM test_table""",
    "le_int": f"SELECT _file_id, _offset, id, {_le('_partition', 2)} AS le16, {_le('id', 4)} AS le32, {_le('parent_id', 8)} AS le64 FROM test_table",
    "leb128_length": f"SELECT doc_id, {_varint('strlen(text)')} AS length FROM documents",
    "fixed_string": f"SELECT _file_id, id, rpad({_cut('name', 12)}, 24, '20') AS fixed FROM test_table",
    "max_string": f"SELECT _file_id, id, {_cut('name', 9)} AS cut FROM test_table",
    "utf8_truncate": f"SELECT doc_id, {_cut('text', 120)} AS cut FROM documents",
    "decimal_scaled": f"SELECT _file_id, id, CAST(trunc(money_spent * 100) AS BIGINT) AS scaled, {_le('trunc(money_spent * 100)', 8)} AS bytes FROM test_table",
    "decimal_wide": f"SELECT _file_id, id, CASE WHEN money_spent < 0 AND money_spent * 1000000 != 0 THEN repeat('FF', 8) ELSE repeat('00', 8) END || {_le('CAST(money_spent * 1000000 AS BIGINT)', 8)} AS bytes FROM test_table",
    "float_bytes": f"SELECT _file_id, id, {_HEIGHT_LE} AS le64, {_WIDTH_LE} AS le32 FROM test_table",
    "native_time": f"SELECT _file_id, id, {_le(f'({_US} - 946684800000000)', 8)} AS micros, {_le(f'({_US} // 86400000000 - 10957)', 8)} AS days FROM test_table",
    "rowbinary_time": f"SELECT _file_id, id, {_le(f'({_US} // 1000000)', 4)} AS seconds, {_le(f'({_US} // 86400000000)', 2)} AS days FROM test_table",
    "rowbinary_row": f"""SELECT _file_id, {_le('id', 4)} || CASE WHEN name IS NULL THEN '01' ELSE '00' || {_varint('strlen(name)')} || hex(encode(name)) END || {_le('is_enabled::INT', 1)} || {_varint('len(child_ids)')}
      || array_to_string(list_transform(child_ids, lambda x: {_le('x', 4).replace('lambda i:', 'lambda j:').replace('CAST(i * 8', 'CAST(j * 8')}), '') || CASE WHEN parent_id IS NULL THEN '01' ELSE '00' || {_le('parent_id', 8)} END
      || {_le('CAST(money_spent * 1000000 AS BIGINT)', 8)} || {_le(f'({_US} // 1000000)', 4)} || {_HEIGHT_LE} || {_WIDTH_LE} || {_UUID_HALVES} || '02' || {_WIDTH_LE} || {_WIDTH_LE} AS "row" FROM test_table""",
    "native_row": f"""WITH v AS (SELECT _file_id, parent_id IS NULL AS n, {_SQL_NATIVE} AS h FROM test_table) SELECT _file_id, {_le('(strlen(h) // 2)', 4)} || CASE WHEN n THEN '1000' ELSE '0000' END || h AS "row" FROM v""",
    "two_phase_positions": f"""WITH {_FR} SELECT topic, "partition", ARG_MAX(end_offset, _file_id) + 1 AS "offset", COALESCE(ARG_MAX({{'w': epoch_us(_end_watermark) // 1000}}, _file_id).w, 0) AS watermark_ms FROM fr WHERE _consumer_group = '{GROUP}' GROUP BY 1, 2""",
    "multiset_readback": """SELECT CAST("timestamp" AS DATE) AS day, _topic, COUNT(*) AS records, COUNT(DISTINCT id) AS ids, CAST(SUM(money_spent) AS DECIMAL(38,6)) AS money_spent,
      COUNT(DISTINCT height) AS height, COUNT(DISTINCT width) AS width, COUNT(DISTINCT transaction_id) AS transaction_id FROM test_table GROUP BY 1, 2""",
    "stateful_watermark": _W + "SELECT topic, \"partition\", \"offset\", timestamp_ms, watermark_ms FROM w",
    "file_paths": _L + """, f AS (SELECT CAST(make_timestamp(timestamp_ms * 1000) AS DATE) AS day, "partition" % 2 AS part, topic, "partition", MIN("offset") AS s, MAX("offset") AS e FROM log WHERE timestamp_ms >= 0 GROUP BY ALL),
      h AS (SELECT day, part, md5(string_agg(concat_ws(':', topic, "partition", s, e), ';' ORDER BY topic, "partition")) AS h FROM f GROUP BY 1, 2)
      SELECT day, part, strftime(day, 'dt=%Y%m%d') || '/' || concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) || '.zst' AS path FROM h""",
}

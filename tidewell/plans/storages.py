"""Queries of storages, file formats, payloads and settings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.commit import formats, loading, metadata, protocols
from tidewell.commit.ledger import Ledger, Offset, positions_frame
from tidewell.encode import avro, binary, protobuf, rowbinary
from tidewell.model import KEYS, RECORD, Position, Range
from tidewell.operators import formatting, positions, watermark
from tidewell.operators.commit_strategy import AnyOf, FuzzyAnyOf
from tidewell.plans import ingest as base
from tidewell.plans.ingest import GROUP, NOW_MS
from tidewell.session import load, lookup, scratch, staged
from tidewell.sources import files
from tidewell.sources import log as logs
from tidewell.sources.files import Compression
from tidewell.streaming.engine import Ingest

#: Starts of the stream in which the log is read by offset; each polls the end of the one before again.
STARTS = 2


def _replayed(spark: SparkSession, d: str, path: str, run: Callable[[DataFrame], None], starts: int) -> None:
    rec = load(spark, d, "stream_record")
    width = (rec.agg(F.max("offset")).first()[0] or 0) // starts + 1
    for i in range(starts):
        low = max(0, i * width - width // 4)
        rec.filter((F.col("offset") >= low) & (F.col("offset") < (i + 1) * width)).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(RECORD).parquet(f"{path}/in"))


def _ingested(spark: SparkSession, d: str, make: Callable[[str], protocols.Storage], formatter: formatting.Formatter, result: Callable[[protocols.Storage], DataFrame], starts: int = STARTS, **settings) -> DataFrame:
    with scratch(spark, "ingest") as path:
        last = []

        def run(stream: DataFrame) -> None:
            last[:] = [make(path)]  # a new process knows what is on disk only
            Ingest(storage=last[0], formatter=formatter, now=lambda: NOW_MS, **settings).start(stream, f"{path}/checkpoint").awaitTermination()

        _replayed(spark, d, path, run, starts)
        return staged(result(last[0]), "ingested")


def _named(records: DataFrame) -> DataFrame:
    kept = formatting.filtering("value is not null")(records)
    return kept.withColumn("name", formatting.payload_fields(F.col("value"))[1]).drop("key", "value", "timestamp_ms")


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, "offset", "watermark_ms", "name")


def streaming_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The log through the streaming engine, cut at the default number of records, into a table with its offsets; read back."""
    return _ingested(spark, d, lambda p: protocols.TableStorage(spark, f"{p}/table", GROUP), _named, lambda s: _columns(s.read()), starts=3)


def ingest_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """Into staged and renamed files, sorted within files, cut by records and bytes."""
    make = lambda p: protocols.TwoPhaseStorage(spark, f"{p}/out", Ledger(spark, f"{p}/ledger", GROUP), protocols.Layout(sort_by=("offset",)))
    return _ingested(spark, d, make, _named, lambda s: _columns(s.read()), strategy=AnyOf(records=2000, size=60_000))


def ingest_multipart(spark: SparkSession, d: str) -> DataFrame:
    """Into uploads that are completed, ORC files."""
    make = lambda p: protocols.MultipartStorage(spark, f"{p}/out", Ledger(spark, f"{p}/ledger", GROUP), protocols.Layout("orc"))
    return _ingested(spark, d, make, lambda r: _named(r).drop(protocols.BATCH), lambda s: _columns(s.read()), coalesce=True)


def ingest_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions committed with metadata by a two-phase ingest, groups apart."""

    def result(s: protocols.TwoPhaseStorage) -> DataFrame:
        return positions_frame(spark, s.committed_positions(set(s.ledger.committed())))

    make = lambda p: protocols.TwoPhaseStorage(spark, f"{p}/out", Ledger(spark, f"{p}/ledger", GROUP))
    return _ingested(spark, d, make, _named, result, group=lambda: F.concat(F.lit("partition_"), (F.col("partition") % 2).cast("string")))


def ingest_in_row(spark: SparkSession, d: str) -> DataFrame:
    """Rows that carry their positions under names of the user's choice."""

    def shape(records: DataFrame) -> DataFrame:
        return records.select(F.col("topic").alias("t"), F.col("partition").alias("p"), F.col("offset").alias("o"), F.timestamp_millis("watermark_ms").cast("timestamp_ntz").alias("w"), protocols.BATCH)

    make = lambda p: protocols.InRowStorage(spark, f"{p}/table", GROUP, columns=("t", "p", "o", "w"))
    return _ingested(spark, d, make, shape, lambda s: s.read().select(F.col("t").alias("topic"), F.col("p").alias("partition"), F.col("o").alias("offset"), F.unix_millis(F.col("w").cast("timestamp")).alias("watermark_ms")))


def ingest_external(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a file id, and the offsets of each file in a second table; joined."""

    def result(s: protocols.ExternalOffsetStorage) -> DataFrame:
        own = s.offsets().select("_file_id", F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), "_start_offset", "_end_offset")
        inside = (F.col("offset") >= F.col("_start_offset")) & (F.col("offset") <= F.col("_end_offset"))
        return s.read().join(lookup(own, "offsets"), ["_file_id", *KEYS], "left").groupBy("_file_id", *KEYS).agg(F.count(F.lit(1)).alias("records"), F.count(F.when(inside, 1)).alias("inside"))

    make = lambda p: protocols.ExternalOffsetStorage(spark, f"{p}/table", GROUP)
    return _ingested(spark, d, make, lambda r: r.select(*KEYS, "offset", protocols.BATCH), result, coalesce=True)


def two_phase_recover(spark: SparkSession, d: str) -> DataFrame:
    """A commit that fails after its offsets were staged, and one before, by real storages; what recovery makes of each."""
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))
    spans = log.groupBy(*KEYS).agg(F.max("offset").alias("o")).collect()  # a row per partition
    covered = [Range(r["topic"], r["partition"], Position(0, 0), Position(r["o"], 7)) for r in spans]
    out = None
    for fault in ("stage_offsets", "store", "finalize"):
        with scratch(spark, "recover") as path:
            make = lambda path=path: protocols.TwoPhaseStorage(spark, f"{path}/out", Ledger(spark, f"{path}/ledger", GROUP))
            storage = make()
            storage.fail_at = fault
            try:
                storage.commit_batch(log, covered)
            except OSError:
                pass
            storage = make()
            storage.recover({(r.topic, r.partition) for r in covered})
            at = positions_frame(spark, storage.committed_positions({(r.topic, r.partition) for r in covered})).select(*KEYS, F.col("offset").alias("next"))
            found = storage.read() if storage.folder.exists("data") else log.filter("false")
            counted = found.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("records"))
            one = staged(at.join(counted, KEYS, "left").select(F.lit(fault).alias("fault"), *KEYS, "next", F.coalesce("records", F.lit(0)).cast("bigint").alias("records")), "recovered")
            out = one if out is None else out.unionByName(one)
    return out


def ledger_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions committed to a ledger of offsets and read from it."""
    with scratch(spark, "ledger") as path:
        at = positions.external(load(spark, d, "file_offsets"), GROUP).collect()  # a row per partition
        Ledger(spark, path, GROUP).commit({(r["topic"], r["partition"]): Offset(r["offset"], metadata.CommitMetadata(r["watermark_ms"] or 0).serialize()) for r in at})
        back = Ledger(spark, path, GROUP).committed()
        return staged(positions_frame(spark, {k: Position(o.offset, metadata.CommitMetadata.deserialize(o.metadata).watermark_ms) for k, o in back.items()}), "positions")


def resumed_log(spark: SparkSession, d: str) -> DataFrame:
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))
    rows = logs.from_positions(log, positions.external(load(spark, d, "file_offsets"), "loader_audit"))
    return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("records"), F.min("offset").alias("first"), F.max("seed_ms").alias("seed_ms"))


def own_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Watermarks by a provider of one's own: a minute behind, never checked against the clock."""
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))
    return watermark.with_watermark(log, NOW_MS, provider=lambda ts, now, skew: ts - 60_000)


def cut_by_default(spark: SparkSession, d: str) -> DataFrame:
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))
    return Ingest().strategy.cut(log, ["topic"]).select(*KEYS, "offset", "batch")


def cut_by_size(spark: SparkSession, d: str) -> DataFrame:
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms", "key", "value"))
    return AnyOf(records=700, size=20_000).cut(log, ["topic"]).select(*KEYS, "offset", "batch")


def cut_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """A drawn limit without deviation."""
    log = logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms"))
    return FuzzyAnyOf(records=(300, 0), seed=1).cut(log, ["topic"]).select(*KEYS, "offset", "batch")


def polled_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of batch sizes: count, greatest and percentiles."""
    sizes = load(spark, d, "stream_record").groupBy("topic", F.expr("offset div 100").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("batches"), F.max("n").alias("max"), *[F.round(F.percentile("n", q / 100), 3).alias(f"p{q}") for q in (50, 95, 99)])


# files in formats of their own

def _table(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "test_table").filter("_file_id is not null").withColumn(protocols.BATCH, F.col("_file_id"))


def _stored(spark: SparkSession, d: str, builder: formats.FileBuilder, result: Callable[[formats.FormatStorage], DataFrame], folder: Callable[[], Column] | None = None) -> DataFrame:
    """The table's files written by a builder, each within a folder of its day, and read back."""
    with scratch(spark, "formats") as path:
        storage = formats.FormatStorage(spark, f"{path}/out", Ledger(spark, f"{path}/ledger", GROUP), builder, folder or (lambda: formatting.date_path(F.col("timestamp"))))
        storage.commit_batch(_table(spark, d), [Range("t", 0, Position(0), Position(1))])
        return staged(result(storage), "formats")


_TEXT = base._CSV
_HARD = T.StructType([
    T.StructField("id", T.IntegerType(), False), T.StructField("name", T.StringType(), True), T.StructField("height", T.DoubleType(), False), T.StructField("width", T.FloatType(), False),
    T.StructField("transaction_id", T.StringType(), False, {"uuid": True}), T.StructField("money_spent", T.DecimalType(18, 6), False),
])


def _day() -> Column:
    return F.regexp_extract("path", "^([^/]*)/", 1)


def csv_files(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, formats.csv_files(_TEXT, compression=Compression.GZIP), lambda s: s.read_lines().select(_day().alias("day"), "line"))


def rowbinary_files(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, formats.rowbinary_files(_HARD, Compression.ZSTD), _digests)


def native_files(spark: SparkSession, d: str) -> DataFrame:
    return _stored(spark, d, formats.native_files(_HARD, Compression.BZIP), _digests)


def _digests(s: formats.FormatStorage) -> DataFrame:
    """Per folder: files, bytes, and a digest over the files' digests."""
    each = s.read().select(_day().alias("day"), F.octet_length("content").alias("n"), F.md5(F.hex("content").cast("binary")).alias("h"))
    return each.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"), F.md5(F.array_join(F.sort_array(F.collect_list("h")), "").cast("binary")).alias("content"))


def text_readback(spark: SparkSession, d: str) -> DataFrame:
    """Lines of topic, partition, offset, watermark and content; the content holds separators."""
    text = lambda: F.concat_ws(";", "_topic", "_partition", "_offset", F.coalesce(F.unix_millis(F.col("_watermark").cast("timestamp")), F.lit(-1)), F.concat_ws(";", "id", "transaction_id"))

    def result(s: formats.FormatStorage) -> DataFrame:
        return files.read_lines(spark, s.folder.full("data"))

    with scratch(spark, "formats") as path:
        storage = formats.FormatStorage(spark, f"{path}/out", Ledger(spark, f"{path}/ledger", GROUP), formats.lines(text))
        storage.commit_batch(_table(spark, d).dropna(subset=["_topic", "_partition", "_offset"]), [Range("t", 0, Position(0), Position(1))])
        return staged(result(storage), "lines")


def codec_readback(spark: SparkSession, d: str) -> DataFrame:
    """Every codec of files of one's own, written and read."""
    text = lambda: F.concat_ws(";", "_topic", "id")
    out = None
    for c in Compression:
        one = _stored(spark, d, formats.lines(text, c), lambda s: s.read_lines().groupBy(F.split("line", ";")[0].alias("topic")).agg(F.count(F.lit(1)).alias("records")))
        one = one.withColumn("codec", F.lit(c.value[0]))
        out = one if out is None else out.unionByName(one)
    return out


#: Rows of a table that are written in other files and read back at a time, portions at most, and rows of a file.
PORTION_ROWS, PORTIONS, FILE_ROWS = 50_000, 32, 25_000


def _portions(table: DataFrame, path: str) -> list[list[str]]:
    """The table's rows, each once, as lists of files below path of about as many rows each."""
    rows = table.count()
    most = max(1, min(PORTIONS, -(-rows // PORTION_ROWS)))
    table.write.option("compression", "zstd").option("maxRecordsPerFile", max(1, rows // most // 8)).parquet(path)
    names = sorted(table.sparkSession.read.schema(table.schema).parquet(path).inputFiles())
    return [part for i in range(most) if (part := names[i::most])]


def parquet_settings(spark: SparkSession, d: str) -> DataFrame:
    """Parquet files by each codec, without a dictionary and with small pages; read back.

    A bloom filter takes 1 MB per column in each row group of 1 MB, so the files
    are some twenty times the table: they are written by portions, each read back
    and deleted before the next, and a file's filters are held until it is closed."""
    table = load(spark, d, "test_table")
    with scratch(spark, "parquet") as path:
        portions = _portions(table, f"{path}/table")
        for c in (Compression.NONE, Compression.ZSTD, Compression.GZIP, Compression.SNAPPY, Compression.LZ4):
            config = files.ParquetConfig(c, block_size=1 << 20, page_size=1 << 14, dictionary=False, bloom_filter=True)
            for part in portions:
                with scratch(spark, "portion") as at:
                    spark.read.schema(table.schema).parquet(*part).write.options(**config.options()).option("maxRecordsPerFile", FILE_ROWS).parquet(at)
                    back = files.read_parquet(spark, at).groupBy("_topic").agg(F.count(F.lit(1)).alias("records"), F.sum("money_spent").alias("money_spent"))
                    back.withColumn("codec", F.lit(c.value[0])).write.mode("append").parquet(f"{path}/totals")
        totals = spark.read.parquet(f"{path}/totals").groupBy("_topic", "codec")
        whole = totals.agg(F.sum("records").alias("records"), F.sum("money_spent").cast("decimal(38,6)").alias("money_spent"))
        return staged(whole.select("_topic", "records", "money_spent", "codec"), "parquet")


# values

def uuid_bytes(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("transaction_id")
    wire = rowbinary.value(T.StructField("transaction_id", T.StringType(), False, {"uuid": True}), u)
    return load(spark, d, "test_table").select("_file_id", "id", F.hex(binary.uuid_bytes(u)).alias("plain"), F.hex(wire).alias("halves"))


def byte_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Keys and payloads: with their length, cut, and padded."""
    rec = load(spark, d, "stream_record").select(*KEYS, "offset", "key", "value").distinct()
    return rec.select(*KEYS, "offset", F.hex(F.concat(binary.leb128(F.octet_length("value")), F.col("value"))).alias("sized"), F.hex(binary.cut_bytes(F.col("value"), 7)).alias("cut"), F.hex(binary.fixed_bytes(F.col("key"), 6)).alias("fixed"))


def file_id_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = formatting.with_file_id(formatting.filtering("timestamp_ms >= 0"), 7)(logs.scan(load(spark, d, "stream_record").select(*KEYS, "offset", "timestamp_ms")))
    return rows.select("_file_id", *KEYS, "offset")


#: A payload of three fields, as Avro and as Protobuf have it.
AVRO = '{"type": "record", "name": "r", "fields": [{"name": "name", "type": "string"}, {"name": "n", "type": "long"}, {"name": "text", "type": ["null", "string"]}, {"name": "parts", "type": {"type": "array", "items": "int"}}]}'
PROTO: protobuf.Message = [(1, "name", "string"), (2, "n", "int64"), (3, "text", "string"), (4, "parts", "repeated sint32")]


def _zigzag(n: Column) -> Column:
    return F.when(n >= 0, n * 2).otherwise(-n * 2 - 1)


def _payload_parts(spark: SparkSession, d: str, n: Column) -> DataFrame:
    """Numbers of a payload, folded so that they are not negative, before they are written."""
    ids = F.transform(F.filter("child_ids", lambda x: x.isNotNull()), lambda x: _zigzag(x.cast("bigint")))
    t = load(spark, d, "test_table").select("_file_id", "id", F.coalesce("name", F.lit("")).alias("name"), F.col("parent_id").cast("string").alias("text"), n.alias("n"), ids.alias("ids"))
    return t.withColumn("parts", F.aggregate("ids", F.lit(b""), lambda a, x: F.concat(a, binary.leb128(x))))


def _sized(text: Column) -> Column:
    return F.concat(binary.leb128(F.octet_length(text) * 2), F.encode(text, "utf-8"))


def avro_payload(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the table as Avro, written by expressions, and read by the reader of payloads."""
    t = _payload_parts(spark, d, _zigzag(F.coalesce("parent_id", F.lit(-5))))
    parts = F.when(F.size("ids") > 0, F.concat(binary.leb128(F.size("ids") * 2), F.col("parts"))).otherwise(F.lit(b""))
    text = F.when(F.col("text").isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\x02"), _sized(F.col("text"))))
    value = F.concat(_sized(F.col("name")), binary.leb128(F.col("n")), text, parts, F.lit(b"\0"))
    return avro.payload(AVRO, strict=True)(t.select("_file_id", "id", value.alias("value"))).withColumn("parts", F.array_join("parts", ";"))


def protobuf_payload(spark: SparkSession, d: str) -> DataFrame:
    """The same as Protocol buffers, with repeated numbers packed."""
    t = _payload_parts(spark, d, F.coalesce(F.abs("parent_id"), F.lit(5)))
    string = lambda tag, s: F.concat(F.lit(bytes([tag])), binary.leb128(F.octet_length(s)), F.encode(s, "utf-8"))
    text = F.when(F.col("text").isNull(), F.lit(b"")).otherwise(string(0x1A, F.col("text")))
    value = F.concat(string(0x0A, F.col("name")), F.lit(b"\x10"), binary.leb128(F.col("n")), text, F.lit(b"\x22"), binary.leb128(F.octet_length("parts")), F.col("parts"))
    return protobuf.payload(PROTO, strict=True)(t.select("_file_id", "id", value.alias("value"))).withColumn("parts", F.array_join("parts", ";"))


def _totals(rows: DataFrame, no_text: Column, label: str) -> DataFrame:
    """Records and the exact sum of n: a bigint, as in the SQL, unless a sum has no room there (the SQL has no result then), else a decimal."""
    out = staged(rows.groupBy(no_text.alias("no_text")).agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n")), label)
    wide = out.filter(F.col("n").isNotNull() & F.col("n").try_cast("bigint").isNull())
    return out if wide.head(1) else out.withColumn("n", F.col("n").cast("bigint"))


def avro_files(spark: SparkSession, d: str) -> DataFrame:
    """Parquet files with the columns of an Avro schema."""
    with scratch(spark, "avro") as path:
        avro_payload(spark, d).select(*[f.name for f in avro.struct_of(AVRO).fields]).write.options(**files.ParquetConfig().options()).parquet(path)
        return _totals(spark.read.parquet(path), F.col("text").isNull(), "avro")


def protobuf_files(spark: SparkSession, d: str) -> DataFrame:
    """Parquet files with the columns of a Protobuf message."""
    with scratch(spark, "protobuf") as path:
        protobuf_payload(spark, d).select(*protobuf.struct_of(PROTO).names).write.options(**files.ParquetConfig(Compression.SNAPPY).options()).parquet(path)
        return _totals(spark.read.parquet(path), F.col("text") == "", "protobuf")


# settings and statements

def commit_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What is committed beside the start offset while a file is staged."""
    r = base._file_ranges(spark, d).filter(F.col("_consumer_group") == GROUP)
    staging = F.concat(F.lit("file-"), F.col("_file_id").cast("string"))
    wm = F.coalesce("end_watermark_ms", F.lit(0))
    return r.select("_file_id", *KEYS, metadata.json_column(wm, staging, F.col("start_offset"), wm, F.col("end_offset"), wm).alias("metadata"))


def load_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for c in Compression:
        for kind, make in (("csv", loading.copy_csv), ("native", loading.copy_native)):
            for m in loading.LoadMethod:
                try:
                    rows.append((c.value[0], kind, m.value, make("t", "/f", c, m)))
                except ValueError:
                    rows.append((c.value[0], kind, m.value, "refused"))
    return spark.createDataFrame(rows, "codec string, kind string, method string, statement string")


def source_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of the log's own source, for all topics of the log from committed positions."""
    at = positions.external(load(spark, d, "file_offsets"), GROUP).select("topic", "partition", "offset").collect()  # a row per partition
    by: dict[str, dict[int, int]] = {}
    for r in sorted(at, key=lambda r: (r["topic"], r["partition"])):
        by.setdefault(r["topic"], {})[r["partition"]] = r["offset"]
    out = logs.kafka_options("h:1", sorted(by), positions=by)
    return spark.createDataFrame([(k, v.replace(" ", "")) for k, v in out.items()], "name string, value string")


QUERIES = {
    f.__name__: f
    for f in (
        streaming_ingest, ingest_two_phase, ingest_multipart, ingest_positions, ingest_in_row, ingest_external, two_phase_recover, ledger_positions, resumed_log, own_watermark, cut_by_default, cut_by_size,
        cut_fuzzy, polled_sizes, csv_files, rowbinary_files, native_files, text_readback, codec_readback, parquet_settings, uuid_bytes, byte_arrays, file_id_rows, avro_payload, protobuf_payload, avro_files,
        protobuf_files, commit_metadata, load_statements, source_options,
    )
}

_L, _W, _FR = base._L, base._W, base._FR
_INGEST = _W + """, pay AS (SELECT topic, "partition", "offset", MAX(value) AS value FROM stream_record GROUP BY ALL)
SELECT w.topic, w."partition", w."offset", w.watermark_ms, string_split(decode(pay.value), ';')[2] AS name
FROM w JOIN pay ON pay.topic = w.topic AND pay."partition" = w."partition" AND pay."offset" = w."offset" WHERE pay.value IS NOT NULL"""


def _cuts(n: int) -> str:
    return _L + f"""SELECT topic, "partition", "offset", (ROW_NUMBER() OVER (PARTITION BY topic ORDER BY timestamp_ms, topic, "partition", "offset") - 1) // {n} AS batch FROM log"""


_UUID, _UUID_HALVES, _WIDTH, float_le = base._UUID, base._UUID_HALVES, base._WIDTH, base.float_le
_HARD_TAIL = f"{float_le('height', 'DOUBLE')} || {float_le('width', 'FLOAT')}"
_RB_HARD = f"""{base._le('id', 4)} || CASE WHEN name IS NULL THEN '01' ELSE '00' || {base._varint('strlen(name)')} || hex(encode(name)) END || {_HARD_TAIL} || {_UUID_HALVES} || {base._le('CAST(money_spent * 1000000 AS BIGINT)', 8)}"""
_NATIVE_VALUES = f"""{base._le('id', 4)} || COALESCE({base._le('strlen(name)', 4)} || hex(encode(name)), '') || {float_le('height', 'DOUBLE')} || {float_le(_WIDTH, 'DOUBLE')} || {_UUID} || {base._le('CAST(money_spent * 1000000 AS BIGINT)', 8)}"""
#: The header of a native file of these columns.
_NATIVE_HEADER = formats.native.header(_HARD).hex().upper()


def _files(row: str, header: str = "") -> str:
    return f"""WITH r AS (SELECT _file_id, strftime("timestamp", 'dt=%Y%m%d') AS day, {row} AS h FROM test_table WHERE _file_id IS NOT NULL),
      f AS (SELECT day, _file_id, '{header}' || string_agg(h, '' ORDER BY h) AS c FROM r GROUP BY ALL)
      SELECT day, COUNT(*) AS files, CAST(SUM(strlen(c) // 2) AS BIGINT) AS bytes, md5(string_agg(md5(c), '' ORDER BY md5(c))) AS content FROM f GROUP BY day"""


_LINE = base.SQL["csv_line"].split("SELECT _file_id, ", 1)[1].rsplit(" AS line FROM", 1)[0]
_IDS = "array_to_string(list_filter(child_ids, lambda x: x IS NOT NULL), ';')"
_PAY = f"""SELECT _file_id, id, COALESCE(name, '') AS name, {{n}} AS n, {{text}} AS text, {_IDS} AS parts FROM test_table"""
_AVRO = _PAY.format(n="COALESCE(parent_id, -5)", text="CAST(parent_id AS VARCHAR)")
_PROTO = _PAY.format(n="COALESCE(abs(parent_id), 5)", text="COALESCE(CAST(parent_id AS VARCHAR), '')")
_CODECS = {"none": "", "zstd": " ZSTD", "gzip": " GZIP", "bzip": " BZIP", "snappy": None, "lz4": None}

SQL = {
    **dict.fromkeys(("streaming_ingest", "ingest_two_phase", "ingest_multipart"), _INGEST),
    "ingest_positions": _W + """SELECT topic, "partition", MAX("offset") + 1 AS "offset", MAX(watermark_ms) AS watermark_ms FROM w GROUP BY ALL""",
    "ingest_in_row": _W + """SELECT topic, "partition", "offset", watermark_ms FROM w""",
    "ingest_external": f"""WITH log AS (SELECT DISTINCT topic, "partition", "offset" FROM stream_record WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL),
      s AS (SELECT *, "offset" // ((SELECT MAX("offset") FROM stream_record) // {STARTS} + 1) AS start FROM log),
      ids AS (SELECT start, ROW_NUMBER() OVER (ORDER BY start) AS _file_id FROM (SELECT DISTINCT start FROM s))
      SELECT _file_id, topic, "partition", COUNT(*) AS records, COUNT(*) AS inside FROM s JOIN ids USING (start) GROUP BY ALL""",
    "two_phase_recover": _L + """, p AS (SELECT topic, "partition", MAX("offset") AS o, COUNT(*) AS n FROM log GROUP BY ALL)
      SELECT fault, topic, "partition", CASE WHEN fault <> 'stage_offsets' THEN o + 1 END AS next, CASE WHEN fault <> 'stage_offsets' THEN n ELSE 0 END AS records
      FROM p CROSS JOIN (VALUES ('stage_offsets'), ('store'), ('finalize')) AS f(fault)""",
    "ledger_positions": f"""WITH {base._ext(GROUP)} SELECT topic, "partition", "offset", COALESCE(watermark_ms, 0) AS watermark_ms FROM pos""",
    "resumed_log": _L + f""", {base._ext('loader_audit')} SELECT log.topic, log."partition", COUNT(*) AS records, MIN(log."offset") AS first, MAX(pos.watermark_ms) AS seed_ms
      FROM log LEFT JOIN pos ON pos.topic = log.topic AND pos."partition" = log."partition" WHERE pos."offset" IS NULL OR log."offset" >= pos."offset" GROUP BY 1, 2""",
    "own_watermark": _L + """SELECT *, GREATEST(-1, COALESCE(MAX(timestamp_ms - 60000) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS UNBOUNDED PRECEDING), -1)) AS watermark_ms FROM log""",
    "cut_by_default": _cuts(1000),
    "cut_fuzzy": _cuts(300),
    "cut_by_size": """WITH log AS (SELECT topic, "partition", "offset", MAX(timestamp_ms) AS timestamp_ms, MAX(key) AS key, MAX(value) AS value FROM stream_record
        WHERE topic IS NOT NULL AND "partition" IS NOT NULL AND "offset" IS NOT NULL GROUP BY ALL),
      s AS (SELECT *, ROW_NUMBER() OVER o - 1 AS n, COALESCE(SUM(COALESCE(octet_length(key), 0) + COALESCE(octet_length(value), 0)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
        FROM log WINDOW o AS (PARTITION BY topic ORDER BY timestamp_ms, topic, "partition", "offset"))
      SELECT topic, "partition", "offset", CAST(n // 700 + b // 20000 AS BIGINT) AS batch FROM s""",
    "polled_sizes": """WITH s AS (SELECT topic, "offset" // 100 AS b, COUNT(*) AS n FROM stream_record GROUP BY ALL)
      SELECT COUNT(*) AS batches, MAX(n) AS max, round(quantile_cont(n, 0.5), 3) AS p50, round(quantile_cont(n, 0.95), 3) AS p95, round(quantile_cont(n, 0.99), 3) AS p99 FROM s""",
    "csv_files": f"""SELECT strftime("timestamp", 'dt=%Y%m%d') AS day, {_LINE} AS line FROM test_table WHERE _file_id IS NOT NULL""",
    "rowbinary_files": _files(_RB_HARD),
    "native_files": _files(f"""{base._le(f'(strlen({_NATIVE_VALUES}) // 2)', 4)} || CASE WHEN name IS NULL THEN '40' ELSE '00' END || {_NATIVE_VALUES}""", _NATIVE_HEADER),
    "text_readback": """SELECT _topic AS topic, _partition AS "partition", _offset AS "offset", COALESCE(epoch_us(_watermark) // 1000, -1) AS watermark_ms, concat_ws(';', id, transaction_id) AS content
      FROM test_table WHERE _file_id IS NOT NULL AND _topic IS NOT NULL AND _partition IS NOT NULL AND _offset IS NOT NULL""",
    "codec_readback": """SELECT codec, COALESCE(_topic, '') AS topic, COUNT(*) AS records FROM (SELECT COALESCE(_topic, id::VARCHAR) AS _topic FROM test_table WHERE _file_id IS NOT NULL)
      CROSS JOIN (VALUES ('none'), ('zstd'), ('gzip'), ('bzip'), ('snappy'), ('lz4')) AS c(codec) GROUP BY ALL""",
    "parquet_settings": """SELECT codec, _topic, COUNT(*) AS records, CAST(SUM(money_spent) AS DECIMAL(38,6)) AS money_spent FROM test_table
      CROSS JOIN (VALUES ('none'), ('zstd'), ('gzip'), ('snappy'), ('lz4')) AS c(codec) GROUP BY ALL""",
    "uuid_bytes": f"SELECT _file_id, id, {_UUID} AS plain, {_UUID_HALVES} AS halves FROM test_table",
    "byte_arrays": f"""SELECT topic, "partition", "offset", {base._varint('octet_length(value)')} || hex(value) AS sized, substr(hex(value), 1, 14) AS cut, rpad(substr(hex(key), 1, 12), 12, '0') AS fixed
      FROM (SELECT DISTINCT topic, "partition", "offset", key, value FROM stream_record)""",
    "file_id_rows": _L + """SELECT CAST(7 AS BIGINT) AS _file_id, topic, "partition", "offset" FROM log WHERE timestamp_ms >= 0""",
    "avro_payload": _AVRO,
    "protobuf_payload": _PROTO,
    "avro_files": f"SELECT text IS NULL AS no_text, COUNT(*) AS records, CAST(SUM(n) AS BIGINT) AS n FROM ({_AVRO}) GROUP BY 1",
    "protobuf_files": f"SELECT text = '' AS no_text, COUNT(*) AS records, CAST(SUM(n) AS BIGINT) AS n FROM ({_PROTO}) GROUP BY 1",
    "commit_metadata": f"""WITH {_FR}, m AS (SELECT *, COALESCE(epoch_us(_end_watermark) // 1000, 0) AS w FROM fr WHERE _consumer_group = '{GROUP}')
      SELECT _file_id, topic, "partition", '{{"watermark":' || w || ',"staged":{{"staging":"file-' || _file_id || '","start_offset":' || start_offset || ',"start_watermark":' || w || ',"end_offset":' || end_offset || ',"end_watermark":' || w || '}}}}' AS metadata FROM m""",
    "load_statements": "SELECT codec, kind, m AS method, CASE WHEN word IS NULL THEN 'refused' ELSE 'COPY t FROM LOCAL ''/f''' || word || CASE WHEN kind = 'csv' THEN ' DELIMITER E''\\\\t''' ELSE ' NATIVE' END || ' ABORT ON ERROR ' || m || ' NO COMMIT' END AS statement FROM (VALUES "
    + ", ".join(f"('{k}', " + ("NULL" if v is None else f"'{v}'") + ")" for k, v in _CODECS.items()) + ") AS c(codec, word) CROSS JOIN (VALUES ('csv'), ('native')) AS k(kind) CROSS JOIN (VALUES ('AUTO'), ('DIRECT'), ('TRICKLE')) AS l(m)",
    "source_options": f"""WITH {base._ext(GROUP)}, t AS (SELECT topic, '"' || topic || '":{{' || string_agg('"' || "partition" || '":' || "offset", ',' ORDER BY "partition") || '}}' AS j FROM pos GROUP BY topic)
      SELECT 'kafka.bootstrap.servers' AS name, 'h:1' AS value UNION ALL SELECT 'subscribe', string_agg(topic, ',' ORDER BY topic) FROM t UNION ALL SELECT 'startingOffsets', '{{' || string_agg(j, ',' ORDER BY topic) || '}}' FROM t""",
}

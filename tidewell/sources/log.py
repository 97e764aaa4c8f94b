"""Reading the record log: tables, topic patterns, and a streaming source."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidewell.model import KEYS, RECORD
from tidewell.operators import small_files
from tidewell.session import lookup


def scan(log: DataFrame) -> DataFrame:
    """Each record once, however often it was polled.

    Copies agree in time; of differing keys or values the greater stands.
    Rows without topic, partition or offset are no records."""
    rest = [c for c in log.columns if c not in (*KEYS, "offset")]
    return log.dropna(subset=[*KEYS, "offset"]).groupBy(*KEYS, "offset").agg(*[F.max(c).alias(c) for c in rest])


def topics(log: DataFrame, names: Sequence[str]) -> DataFrame:
    return log.filter(F.col("topic").isin(list(names)))


def topic_pattern(log: DataFrame, pattern: str) -> DataFrame:
    """Topics that match the whole pattern."""
    return log.filter(F.col("topic").rlike(f"^(?:{pattern})$"))


def offsets_for_times(log: DataFrame, targets: DataFrame) -> DataFrame:
    """targets: (topic, partition, target_ms).  Adds offset and its time: the
    earliest offset whose time is at or after the target, null if none is.

    One grouped minimum; the targets, one per topic partition, are looked up."""
    targets = lookup(targets, "targets")
    hit = log.join(targets, KEYS).filter(F.col("timestamp_ms") >= F.col("target_ms"))
    first = hit.groupBy(*KEYS, "target_ms").agg(F.min(F.struct("offset", "timestamp_ms")).alias("f"))
    return targets.join(first, [*KEYS, "target_ms"], "left").select(*KEYS, "target_ms", F.col("f.offset").alias("offset"), F.col("f.timestamp_ms").alias("timestamp_ms"))


def from_positions(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Records at or beyond the committed positions, with seed_ms, the watermark
    to go on from; partitions without a position start at their beginning."""
    seeds = lookup(positions.select(*KEYS, F.col("offset").alias("__from"), F.col("watermark_ms").alias("seed_ms")), "positions")
    return log.join(seeds, KEYS, "left").filter("__from is null or offset >= __from").drop("__from")


class _Group(InputPartition):
    def __init__(self, file: str, group: int):
        self.file, self.group = file, group


class _Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class LogDataSource(DataSource):
    """A Parquet log, a file or a folder of files in order of their names, on any file
    system that pyarrow knows, as a source, by row groups; as a stream, by row number.

    Options: path; step (rows a trigger may take, none: all there are).  With
    step, an offset is the greatest row taken so far; after a restart the reader
    learns it from the batch Spark plans again.  Use no step with availableNow,
    which asks for one offset only."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_log"

    def schema(self):
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("step", 0)))


def _typed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    columns = [f.name for f in RECORD.fields]
    yield from table.select(columns).to_batches()


def _names(path: str) -> list[str]:
    """The Parquet files of a log, by name."""
    from pyarrow import fs

    files, at = small_files.located(path)
    if files.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{i.base_name}" for i in files.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".parquet"))


def _open(path: str) -> pq.ParquetFile:
    files, at = small_files.located(path)
    return pq.ParquetFile(files.open_input_file(at))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Group(f, g) for f in _names(self.path) for g in range(_open(f).num_row_groups)]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        yield from _typed(_open(partition.file).read_row_group(partition.group))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, step: int):
        self.path, self.step, self.seen = path, step, 0

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        rows = sum(_open(f).metadata.num_rows for f in _names(self.path))
        if not self.step:
            return {"row": rows}
        self.seen = min(rows, self.seen + self.step)
        return {"row": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = max(self.seen, end["row"])
        width = 100_000
        return [_Slice(i, min(i + width, end["row"])) for i in range(start["row"], end["row"], width)]

    def read(self, partition: _Slice) -> Iterator[pa.RecordBatch]:
        at = 0
        for name in _names(self.path):
            file = _open(name)
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                lo, hi = max(partition.start - at, 0), min(partition.end - at, n)
                if lo < hi:
                    yield from _typed(file.read_row_group(g).slice(lo, hi - lo))
                at += n

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


def kafka_options(servers: str, topic_list: Sequence[str] = (), pattern: str | None = None, positions: dict[str, dict[int, int]] | None = None, extra: dict[str, str] | None = None) -> dict[str, str]:
    """Options of Spark's Kafka source (not on this class path: text only).

    Keys and values are always bytes and offsets are never committed by the
    consumer, so settings for either are refused."""
    extra = dict(extra or {})
    if any(k.lower().removeprefix("kafka.") in ("enable.auto.commit", "key.deserializer", "value.deserializer") for k in extra):
        raise ValueError("deserializers and auto commit are fixed")
    if bool(topic_list) == bool(pattern):
        raise ValueError("either topics or a pattern")
    out = {"kafka.bootstrap.servers": servers, **extra}
    out |= {"subscribePattern": pattern} if pattern else {"subscribe": ",".join(topic_list)}
    if positions:
        out["startingOffsets"] = json.dumps({t: {str(p): o for p, o in ps.items()} for t, ps in positions.items()})
    return out


def kafka_log(spark: SparkSession, **kw) -> DataFrame:
    df = spark.readStream.format("kafka").options(**kafka_options(**kw)).load()
    return df.select("topic", "partition", "offset", F.unix_millis("timestamp").alias("timestamp_ms"), "key", "value")

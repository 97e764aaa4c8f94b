"""Session helpers: table loading, the shared folder, time conversion."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def utc(spark: SparkSession) -> None:
    """All event-time arithmetic is UTC; NTZ columns are read as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, from spark.checkpoint.dir.

    A machine-local folder is used only where the setting is absent and the
    session runs in one JVM (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    path = os.path.join(tempfile.gettempdir(), "tidewell-shared")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While it holds, Arrow batches to Python have at most so many rows, for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a lookup table that may be broadcast, of at most some hundred bytes each.
LOOKUP_ROWS = 100_000


def lookup(df: DataFrame, label: str = "lookup", most: int = LOOKUP_ROWS, rows: int | None = None) -> DataFrame:
    """df, to be joined to a large table: broadcast up to so many rows, merged
    beyond.  Written once and counted, unless its number of rows is known."""
    if rows is None:
        df = staged(df, label)
        rows = df.count()
    return F.broadcast(df) if rows <= most else df.hint("merge")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder as zstd parquet and read it back.

    It cuts lineage as a checkpoint does, but columns stay prunable, so later
    passes read only what they use.  The folder is unique, so a retried job
    never reads a half-written one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder of its own in the shared folder, deleted afterwards: stage what is to outlive it."""
    path = f"{shared_dir(spark)}/scratch/{label}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_written: list[tuple[SparkSession, str]] = []


def staged_so_far() -> int:
    return len(_written)


def release(since: int = 0) -> None:
    """Deletes what staged() wrote, or wrote since then; frames read from it are
    void afterwards.  Runs at exit; a long-running stream calls it per batch."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session is gone: the shared folder's owner clears it
            return


atexit.register(release)


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch (floor) of a timestamp or NTZ in UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def ms_to_ntz(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")

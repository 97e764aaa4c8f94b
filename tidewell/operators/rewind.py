"""Rewinding: going back from committed positions to warm up state, without writing again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS, OffsetInterval, WatermarkInterval
from tidewell.operators import scan
from tidewell.session import lookup
from tidewell.sources import log as logs


def by_offset(positions: DataFrame, n: int) -> DataFrame:
    return positions.withColumn("offset", F.when(F.col("offset").isNotNull(), F.greatest(F.lit(0), F.col("offset") - n)))


def by_watermark(positions: DataFrame, log: DataFrame, ms: int) -> DataFrame:
    """Positions of the first record at or after the watermark less ms.
    Positions without a positive watermark, or without such a record, are null."""
    targets = positions.filter("watermark_ms > 0").select(*KEYS, F.greatest(F.lit(0), F.col("watermark_ms") - ms).cast("bigint").alias("target_ms"))
    found = logs.offsets_for_times(log, targets).select(*KEYS, "offset", F.col("timestamp_ms").alias("watermark_ms"))
    return positions.select(*KEYS).join(found, KEYS, "left")


def rewind(positions: DataFrame, log: DataFrame, interval: OffsetInterval | WatermarkInterval) -> DataFrame:
    if interval.is_zero:
        return positions
    return by_offset(positions, interval.length) if isinstance(interval, OffsetInterval) else by_watermark(positions, log, interval.ms)


def split(log: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds rewound: true for records to touch only, false for those to write.

    A partition is done rewinding with the first record, in offset order, at or
    beyond its committed offset, and stays so; without a position nothing is
    written twice, so every record is written."""
    at = lookup(positions.select(*KEYS, F.col("offset").alias("__at")), "positions")
    rows = log.join(at, KEYS, "left").withColumn("__done", F.when(F.coalesce(F.col("offset") >= F.col("__at"), F.lit(True)), F.lit(1)))
    return scan.running_max(rows.drop("__at"), KEYS, "offset", "__done", "__latch", inclusive=True).withColumn("rewound", F.col("__latch").isNull()).drop("__done", "__latch")

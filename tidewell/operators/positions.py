"""Committed positions: the offset to go on from and the watermark, per topic partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS
from tidewell.session import epoch_ms, utc


def in_row(table: DataFrame, topic: str = "_topic", partition: str = "_partition", offset: str = "_offset", watermark: str = "_watermark") -> DataFrame:
    """From the rows' own columns, for all consumer groups."""
    utc(table.sparkSession)
    return (
        table.filter(F.col(topic).isNotNull() & F.col(partition).isNotNull())
        .groupBy(F.col(topic).alias("topic"), F.col(partition).alias("partition"))
        .agg((F.max(offset) + 1).alias("offset"), F.max(epoch_ms(F.col(watermark))).alias("watermark_ms"))
    )


def external(file_offsets: DataFrame, group: str) -> DataFrame:
    """From the offset table of one consumer group."""
    utc(file_offsets.sparkSession)
    return (
        file_offsets.filter((F.col("_consumer_group") == group) & F.col("_topic").isNotNull() & F.col("_partition").isNotNull())
        .groupBy(F.col("_topic").alias("topic"), F.col("_partition").alias("partition"))
        .agg((F.max("_end_offset") + 1).alias("offset"), F.max(epoch_ms(F.col("_end_watermark"))).alias("watermark_ms"))
    )


def requested(partitions: DataFrame, positions: DataFrame) -> DataFrame:
    """A row for each asked partition; null where nothing was committed."""
    return partitions.join(positions, KEYS, "left").select(*KEYS, "offset", "watermark_ms")


def committed(ranges: DataFrame, positions: DataFrame, by: str) -> DataFrame:
    """(by, committed): whether every range of a batch lies below its position.
    Watermarks don't matter; a partition without a position isn't committed."""
    at = positions.select(*KEYS, F.col("offset").alias("__at"))
    return ranges.join(at, KEYS, "left").groupBy(by).agg(F.bool_and(F.coalesce(F.col("__at") > F.col("end_offset"), F.lit(False))).alias("committed"))

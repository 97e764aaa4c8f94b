"""Offset ranges of batches: building, merging and naming them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS


def build(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per batch (by) and topic partition: first position, last offset and
    greatest watermark.  Take it before rows are filtered: dropped rows still
    extend the range."""
    return records.groupBy(*by, *KEYS).agg(
        F.min("offset").alias("start_offset"), F.min_by("watermark_ms", "offset").alias("start_watermark_ms"),
        F.max("offset").alias("end_offset"), F.max("watermark_ms").alias("end_watermark_ms"),
    )


def merge(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Ranges of two consecutive batches as one; partitions of only one side stay."""
    a, b = earlier.alias("a"), later.alias("b")
    both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEYS], "full_outer")
    first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    last = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return both.select(*[first(k) for k in KEYS], first("start_offset"), first("start_watermark_ms"), last("end_offset"), last("end_watermark_ms"))


def token(topic: Column, partition: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", topic, partition.cast("string"), start.cast("string"), end.cast("string"))


def dedup_token(ranges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, token): names a batch by its ranges; a batch has one range a partition."""
    t = token(F.col("topic"), F.col("partition"), F.col("start_offset"), F.col("end_offset"))
    return ranges.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(t)), ";").alias("token"))


def by_file(records: DataFrame, file: Sequence[str]) -> DataFrame:
    """(file…, ranges): the ranges of the records in each file, one a topic partition."""
    each = build(records, file)
    one = F.struct(*KEYS, "start_offset", "start_watermark_ms", "end_offset", "end_watermark_ms")
    return each.groupBy(*file).agg(F.sort_array(F.collect_list(one)).alias("ranges"))

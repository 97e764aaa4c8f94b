"""Merging overlapping intervals per entity and listing the gaps.

Method: globally range-sort by (entity, start); each range partition gives the
maximum end of every entity it ends with; those summaries are prefix-combined;
each partition is rescanned with its carried state, which labels islands.

Intervals have inclusive integer ends.  Defined results: a null start or end,
or an end below the start, covers and bounds nothing; repeated rows change
nothing; touching intervals ([1,3], [4,6]) join; a null in an entity column is
a value of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.scan import range_split


def _usable(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    ok = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start))
    cols = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(entity)]
    rows = df.filter(ok).select(*cols, F.col(start).cast("bigint").alias("__s"), F.col(end).cast("bigint").alias("__e"))
    # the longest of equal starts says all: fewer rows to sort, map-side combined
    return rows.groupBy(*[f"__k{i}" for i in range(len(entity))], "__s").agg(F.max("__e").alias("__e"))


def _scanned(df: DataFrame, entity: Sequence[str], start: str, end: str) -> tuple[DataFrame, list[str]]:
    """Rows (keys, __s, __e, __prev): __prev is the greatest end of all lower starts of the entity."""
    keys = [f"__k{i}" for i in range(len(entity))]
    ranged = range_split(_usable(df, entity, start, end), keys, ["__s"], "intervals")
    # an entity has one summary per range partition it reaches into
    summary = ranged.groupBy(*keys, "__pid").agg(F.max("__e").alias("__e"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.withColumn("__c", F.max("__e").over(before)).filter("__c is not null")
    # the carry enters as a row that sorts before all others of its entity and partition
    rows = ranged.withColumn("__row", F.lit(1)).unionByName(
        carried.select(*keys, "__pid", F.lit(None).cast("bigint").alias("__s"), F.col("__c").alias("__e"), F.lit(0).alias("__row"))
    )
    within = Window.partitionBy("__pid", *keys).orderBy("__row", "__s").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__prev", F.max("__e").over(within)).filter("__row = 1"), keys


def _named(keys: Sequence[str], entity: Sequence[str]) -> list:
    return [F.col(k).alias(c) for k, c in zip(keys, entity, strict=True)]


def gaps(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """(entity…, gap_start, gap_end): the longest runs that no interval covers."""
    rows, keys = _scanned(df, entity, start, end)
    return rows.filter("__prev is not null and __s > __prev + 1").select(
        *_named(keys, entity), (F.col("__prev") + 1).alias("gap_start"), (F.col("__s") - 1).alias("gap_end")
    )


def periods(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """(entity…, period_start, period_end): the continuous covered periods.

    A period starts where a gap ends; its end is the greatest end before the
    next gap, which that gap's row already carries as __prev."""
    rows, keys = _scanned(df, entity, start, end)
    heads = rows.filter("__prev is null or __s > __prev + 1").select(*keys, "__s", "__prev")
    last = rows.groupBy(*keys).agg(F.max("__e").alias("__last"))
    # island heads are ranked per entity by pairs (start, end before the next head): both
    # lists are sorted alike, so each head needs only the head that follows it
    ends = heads.select(*keys, F.col("__prev").alias("__end")).filter("__end is not null").unionByName(last.withColumnRenamed("__last", "__end"))
    marks = heads.select(*keys, F.col("__s").alias("__at"), F.lit(0).alias("__kind")).unionByName(ends.select(*keys, F.col("__end").alias("__at"), F.lit(1).alias("__kind")))
    ordered = range_split(marks, keys, ["__at", "__kind"], "marks")
    # starts and ends alternate: a start's end is the next mark, in its own or the next partition of the entity
    firsts = ordered.groupBy(*keys, "__pid").agg(F.min(F.struct("__at", "__kind")).alias("__f"))
    follow = Window.partitionBy(*keys).orderBy("__pid")
    tail = firsts.withColumn("__n", F.lead("__f").over(follow)).filter("__n is not null").select(*keys, "__pid", F.col("__n.__at").alias("__at"), F.col("__n.__kind").alias("__kind"), F.lit(1).alias("__tail"))
    both = ordered.withColumn("__tail", F.lit(0)).unionByName(tail)
    nxt = Window.partitionBy("__pid", *keys).orderBy("__tail", "__at", "__kind")
    return both.withColumn("__end", F.lead("__at").over(nxt)).filter("__kind = 0 and __tail = 0").select(
        *_named(keys, entity), F.col("__at").alias("period_start"), F.col("__end").alias("period_end")
    )

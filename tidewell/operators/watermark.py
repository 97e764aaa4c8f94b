"""The running watermark: the greatest accepted event time so far, per topic partition.

A time is accepted if it is at most `now` plus the allowed skew (inclusive);
others leave the watermark as it is.  Nothing is ever dropped: late records
stay and see a watermark beyond their own time.  Before any accepted time the
watermark is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.model import KEYS, NO_WATERMARK
from tidewell.operators import scan

SKEW_MS = 3_600_000


def accepted(ts: Column, now_ms: int, skew_ms: int = SKEW_MS) -> Column:
    return F.when(ts <= now_ms + skew_ms, ts)


def with_watermark(log: DataFrame, now_ms: int, skew_ms: int = SKEW_MS, seeds: DataFrame | None = None, out: str = "watermark_ms", provider=accepted) -> DataFrame:
    """log with its running watermark, seeded by (topic, partition, seed_ms) where given.

    seeds have a row per topic partition; hint them by lookup().
    provider: the column to take the running maximum of.  The maximum is taken
    by blocks of offsets, so a partition holding most of the log is no
    bottleneck."""
    rows = log.withColumn("__ts", provider(F.col("timestamp_ms"), now_ms, skew_ms))
    rows = scan.running_max(rows.drop(out), KEYS, "offset", "__ts", "__wm", inclusive=True).drop("__ts")
    if seeds is None:
        return rows.withColumn(out, F.greatest(F.coalesce("__wm", F.lit(NO_WATERMARK)), F.lit(NO_WATERMARK))).drop("__wm")
    rows = rows.join(seeds.select(*KEYS, "seed_ms"), KEYS, "left")
    return rows.withColumn(out, F.greatest(F.coalesce("seed_ms", F.lit(NO_WATERMARK)), F.coalesce("__wm", F.lit(NO_WATERMARK)))).drop("__wm", "seed_ms")

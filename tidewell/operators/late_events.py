"""Late and out-of-order events: hourly panes that late records correct.

Event time is cut into non-overlapping panes at window-boundary granularity.
A record changes exactly one pane; a window is the sum of the panes it covers,
so a late record re-emits only the windows over its pane.  A record is past the
cut-off when the end of its hour plus the allowed lateness is at or before the
greatest watermark of any record with a lower offset in its topic partition.

So a pane of a topic partition closes at one offset, the least that carries a
watermark beyond its end plus the lateness; a record of the pane at a higher
offset came too late.  closings() finds that offset for all panes, combining
watermarks by the latest pane they close before anything is shuffled: what
travels is panes, not records.

Defined results: rows with a null topic, partition or offset are ignored; a
record polled or stored repeatedly counts once; a record without event time in
either table is neither late nor counted; null, -1 and other negative
watermarks are ignored; of several stored versions the greatest file id
supplies timestamp and money (ties: the greater value); a null money counts as
a record and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import scan
from tidewell.session import epoch_ms, lookup, ms_to_ntz, utc

HOUR_MS = 3_600_000
LATENESS_MS = 2 * HOUR_MS
KEYS = ["topic", "partition"]


def log_points(stream_record: DataFrame, test_table: DataFrame) -> DataFrame:
    """Both tables as points (topic, partition, offset, wm_ms, …)."""
    utc(test_table.sparkSession)
    rec = stream_record.select(
        "topic", "partition", "offset",
        F.when(F.col("watermark_ms") >= 0, F.col("watermark_ms")).alias("wm_ms"),
        F.when(F.col("timestamp_ms") >= 0, F.col("timestamp_ms")).alias("polled_ms"),
        F.lit(True).alias("polled"),
        F.lit(None).cast("struct<file_id:bigint,ms:bigint,money:decimal(18,6)>").alias("stored"),
    )
    money = F.col("money_spent").cast("decimal(18,6)") if "money_spent" in test_table.columns else F.lit(None).cast("decimal(18,6)")
    tab = test_table.select(
        F.col("_topic").alias("topic"), F.col("_partition").alias("partition"), F.col("_offset").alias("offset"),
        F.when(epoch_ms(F.col("_watermark")) >= 0, epoch_ms(F.col("_watermark"))).alias("wm_ms"),
        F.lit(None).cast("bigint").alias("polled_ms"),
        F.lit(False).alias("polled"),
        F.struct(F.col("_file_id").alias("file_id"), epoch_ms(F.col("timestamp")).alias("ms"), money.alias("money")).alias("stored"),
    )
    return rec.unionByName(tab).filter("topic is not null and partition is not null and offset is not null")


def judged(stream_record: DataFrame, test_table: DataFrame, lateness_ms: int = LATENESS_MS, pane_ms: int = HOUR_MS, seeds: DataFrame | None = None) -> DataFrame:
    """One row per record: (topic, partition, offset, polled, stored, event_ms, pane_ms, money, met_ms, wm_ms, late).

    late is null when the record has no event time.  seeds: (topic, partition,
    seed_ms), the greatest watermarks of records that came before."""
    points = log_points(stream_record, test_table)
    rows = scan.with_carries(points, KEYS, "offset", "wm_ms")
    per = rows.groupBy(*KEYS, scan.BLOCK, "offset").agg(
        F.max("wm_ms").alias("wm_ms"), F.max("polled_ms").alias("polled_ms"), F.max("polled").alias("polled"),
        F.max("stored").alias("stored"), F.max("__is_carry").alias("__is_carry"),
    )
    w = Window.partitionBy(*KEYS, scan.BLOCK).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("met_ms", F.max("wm_ms").over(w)).filter(~F.col("__is_carry"))
    if seeds is not None:
        per = per.join(lookup(seeds.select(*KEYS, "seed_ms"), "seeds"), KEYS, "left").withColumn("met_ms", F.greatest("met_ms", "seed_ms")).drop("seed_ms")
    per = per.withColumn("event_ms", F.coalesce("polled_ms", F.col("stored.ms")))
    per = per.withColumn("pane_ms", F.col("event_ms") - F.pmod(F.col("event_ms"), F.lit(pane_ms)))
    late = F.coalesce(F.col("pane_ms") + pane_ms + lateness_ms <= F.col("met_ms"), F.lit(False))
    return per.select(
        *KEYS, "offset", "polled", F.col("stored").isNotNull().alias("loaded"), "event_ms", "pane_ms",
        F.col("stored.money").alias("money"), "met_ms", "wm_ms", F.when(F.col("event_ms").isNotNull(), late).alias("late"),
    )


def closings(watermarks: DataFrame, events: DataFrame, lateness_ms: int = LATENESS_MS, pane_ms: int = HOUR_MS) -> DataFrame:
    """(topic, partition, pane, closes_at) of the panes of events that close.

    watermarks: (topic, partition, offset, wm_ms); events: (topic, partition,
    event_ms).  pane is the number of the pane, closes_at the least offset whose
    watermark closes it.  There are at most as many rows as hours a partition's
    events lie in."""
    latest = F.floor((F.col("wm_ms") - lateness_ms) / pane_ms).cast("bigint") - 1
    steps = watermarks.filter("wm_ms is not null").groupBy(*KEYS, latest.alias("pane")).agg(F.min("offset").alias("first"))
    asked = events.filter("event_ms is not null").select(*KEYS, pane_of(pane_ms)).distinct()
    both = steps.withColumn("asked", F.lit(False)).unionByName(asked.select("*", F.lit(None).cast("bigint").alias("first"), F.lit(True).alias("asked")))
    # a pane closes with the first of the steps at or above it
    w = Window.partitionBy(*KEYS).orderBy(F.col("pane").desc()).rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("closes_at", F.min("first").over(w)).filter("asked and closes_at is not null").select(*KEYS, "pane", "closes_at")


def pane_of(pane_ms: int = HOUR_MS) -> Column:
    return F.floor(F.col("event_ms") / pane_ms).cast("bigint").alias("pane")


def after_cutoff(stream_record: DataFrame, test_table: DataFrame, lateness_ms: int = LATENESS_MS, pane_ms: int = HOUR_MS) -> DataFrame:
    """Polled records that came after the cut-off: (topic, partition, offset).

    Each record goes to its pane, and is late if that closed at a lower offset.
    Only records polled without a time are looked up in test_table by offset."""
    points = log_points(stream_record, test_table)
    polled = points.filter("polled")
    untimed = polled.filter("polled_ms is null").select(*KEYS, "offset").distinct()
    stored = points.filter("not polled").select(*KEYS, "offset", "stored").join(untimed.hint("merge"), [*KEYS, "offset"], "left_semi")
    found = stored.groupBy(*KEYS, "offset").agg(F.max("stored")["ms"].alias("event_ms"))
    timed = polled.filter("polled_ms is not null").select(*KEYS, "offset", F.col("polled_ms").alias("event_ms"))
    events = timed.unionByName(found).filter("event_ms is not null")
    panes_closed = lookup(closings(points, events, lateness_ms, pane_ms), "closings")
    late = events.withColumn("pane", pane_of(pane_ms)).join(panes_closed, [*KEYS, "pane"]).filter(F.col("offset") > F.col("closes_at"))
    return late.select(*KEYS, "offset").distinct()


def panes(judged_rows: DataFrame) -> DataFrame:
    """Panes of records that still count: (topic, pane_ms, records, loaded, money_spent, late_records)."""
    return judged_rows.filter("event_ms is not null and not late").groupBy("topic", "pane_ms").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum(F.col("loaded").cast("bigint")).alias("loaded"),
        F.coalesce(F.sum("money"), F.lit(0)).cast("decimal(38,6)").alias("money_spent"),
        F.sum((F.col("met_ms") > F.col("event_ms")).cast("bigint")).alias("out_of_order"),
    ).withColumn("out_of_order", F.coalesce("out_of_order", F.lit(0).cast("bigint")))


def merge_panes(saved: DataFrame, delta: DataFrame) -> DataFrame:
    """Panes after adding delta panes; both sides have the columns of panes()."""
    return saved.unionByName(delta).groupBy("topic", "pane_ms").agg(
        F.sum("records").alias("records"), F.sum("loaded").alias("loaded"),
        F.sum("money_spent").cast("decimal(38,6)").alias("money_spent"), F.sum("out_of_order").alias("out_of_order"),
    )


def compose_windows(pane_rows: DataFrame, panes_per_window: int, pane_ms: int = HOUR_MS, changed: DataFrame | None = None) -> DataFrame:
    """Sliding windows of panes_per_window panes, one starting at each pane.

    changed: (topic, pane_ms) of panes just touched; then only windows that
    cover one of them are composed.  Windows without records have no row."""
    ago = F.explode(F.sequence(F.lit(0), F.lit(panes_per_window - 1)))
    spread = pane_rows.withColumn("__ago", ago).withColumn("window_start_ms", F.col("pane_ms") - F.col("__ago") * pane_ms)
    if changed is not None:
        touched = changed.withColumn("__ago", ago).select("topic", (F.col("pane_ms") - F.col("__ago") * pane_ms).alias("window_start_ms")).distinct()
        spread = spread.join(touched, ["topic", "window_start_ms"], "left_semi")
    return spread.groupBy("topic", "window_start_ms").agg(
        F.sum("records").alias("records"), F.sum("loaded").alias("loaded"),
        F.sum("money_spent").cast("decimal(38,6)").alias("money_spent"),
    )


def hourly(stream_record: DataFrame, test_table: DataFrame) -> DataFrame:
    return panes(judged(stream_record, test_table)).select(
        "topic", ms_to_ntz(F.col("pane_ms")).alias("hour"), "records", "loaded", "money_spent", "out_of_order"
    )

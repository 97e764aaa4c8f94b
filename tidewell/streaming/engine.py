"""The ingest loop on Structured Streaming: read, watermark, format, cut, commit.

A micro-batch is processed by pure DataFrame functions.  Spark's offset log
makes a failed one come again with the same rows; what was committed of it is
known from the storage's positions, so nothing is written twice.  Cuts are
functions of the records alone, so a replay reproduces them.  All batches of a
group in a micro-batch are written by one job, a file set each, and committed
at once.

Spark runs one micro-batch at a time and reads no further meanwhile: that is the
back-pressure, with a queue of at most one batch."""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewell.commit.ledger import Key, positions_frame
from tidewell.commit.protocols import BATCH, Storage, is_committed
from tidewell.model import KEYS, OffsetInterval, Position, Range, WatermarkInterval
from tidewell.operators import commit_strategy, formatting, ranges, rewind, routing, watermark
from tidewell.session import lookup, release, staged_so_far
from tidewell.sources import log as logs
from tidewell.streaming.retry import Policy, on_failure_if

log = logging.getLogger(__name__)


#: Names under which metrics are reported.
METRIC_NAMES = {
    "polled": "records.polled", "source_delay_ms": "source.watermark.delay.ms", "written": "batch.records.written", "batched": "batch.records.batched",
    "watermark_delay_ms": "batch.committed.watermark.delay.ms", "commit_s": "batch.commit.duration", "queued": "batch.commit.queue.size",
}
#: Latest values of a distribution that are kept.
KEPT = 1024


def quantiles(values) -> dict[str, float]:
    """A distribution as its count, greatest value and percentiles."""
    v = np.asarray(list(values), float)
    return {"count": float(len(v))} | ({"max": float(v.max())} | {f"p{q}": float(np.percentile(v, q)) for q in (50, 95, 99)} if len(v) else {})


@dataclass
class Metrics:
    polled: int = 0
    polled_sizes: deque = field(default_factory=lambda: deque(maxlen=KEPT))
    batched: int = 0
    written: int = 0
    batches: int = 0
    skipped: int = 0
    queued: int = 0
    heartbeats: int = 0
    commit_s: deque = field(default_factory=lambda: deque(maxlen=KEPT))
    source_delay_ms: dict[Key, int] = field(default_factory=dict)
    watermark_delay_ms: dict[Key, int] = field(default_factory=dict)

    def report(self, prefix: str = "ingest") -> dict[str, float]:
        """Names and values; distributions as percentiles, delays per topic partition."""
        name = lambda k: f"{prefix}.{METRIC_NAMES[k]}"
        out: dict[str, float] = {name(k): getattr(self, k) for k in ("polled", "batched", "written", "queued")}
        for k, values in (("polled", self.polled_sizes), ("commit_s", self.commit_s)):
            out |= {f"{name(k)}.{q}": v for q, v in quantiles(values).items()}
        for k in ("source_delay_ms", "watermark_delay_ms"):
            out |= {f"{name(k)}.{t}.{p}": v for (t, p), v in getattr(self, k).items()}
        return out


@dataclass(frozen=True)
class Ingest:
    """An immutable configuration; storage is mandatory.

    formatter: records to rows; rows that keep the column __batch go to a file
    set of their batch.  group: Column naming the partition group that is cut and
    committed together.  strategy: when to cut, by records, bytes or, as the
    trigger's interval, open time; anything with cut() and interval_ms.
    coalesce: commit all groups of a micro-batch at once.
    rewind: how far before its position a partition is read again after a start;
    those records go to warm_up only.  provider: what watermarks are made of.
    now: the clock watermarks are checked against, once per micro-batch."""

    storage: Storage | None = None
    formatter: formatting.Formatter = formatting.identity
    group: Callable[[], Column] = routing.single_group
    strategy: commit_strategy.AnyOf | commit_strategy.FuzzyAnyOf = commit_strategy.AnyOf(records=commit_strategy.DEFAULT_RECORDS)
    coalesce: bool = False
    skew_ms: int = watermark.SKEW_MS
    provider: Callable[[Column, int, int], Column] = watermark.accepted
    now: Callable[[], int] = lambda: int(time.time() * 1000)
    retry: Policy = Policy()
    rewind: OffsetInterval | WatermarkInterval = OffsetInterval(0)
    warm_up: Callable[[DataFrame], None] | None = None
    on_heartbeat: Callable[[str, int], None] | None = None
    metrics: Metrics = field(default_factory=Metrics)
    #: Committed positions, read once per topic partition and then held; positions to rewind to.
    known: dict[Key, Position | None] = field(default_factory=dict, compare=False)
    starts: dict[Key, int | None] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        records = getattr(self.strategy, "records", None)
        if isinstance(records, int) and records < 1:
            raise ValueError("a batch holds at least one record")

    def with_(self, **changes) -> Ingest:
        return replace(self, **({"known": {}, "starts": {}} | changes))

    def build(self) -> Ingest:
        if self.storage is None:
            raise ValueError("a storage is needed")
        if not self.rewind.is_zero and self.warm_up is None:
            raise ValueError("rewinding needs something to warm up")
        return self

    def _positions(self, spark: SparkSession, records: DataFrame, partitions: set[Key]) -> dict[Key, Position | None]:
        """Positions of the partitions; those not seen before are recovered and read."""
        new = partitions - set(self.known)
        if new:
            self.storage.recover(new)
            at = self.storage.committed_positions(new)
            self.known.update(at)
            back = rewind.rewind(positions_frame(spark, at), records, self.rewind) if not self.rewind.is_zero else None
            if back is not None:
                self.starts.update({(r["topic"], r["partition"]): r["offset"] for r in back.collect()})  # a row per partition
        return {k: self.known[k] for k in partitions}

    def process(self, df: DataFrame, batch_id: int) -> None:
        """One micro-batch."""
        self.build()
        spark = df.sparkSession
        kept = staged_so_far()
        records = logs.scan(df).persist()
        try:
            seen = records.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).collect()  # as many as the log has partitions
            if not seen:
                return
            self.metrics.polled_sizes.append(sum(r["n"] for r in seen))
            at = self._positions(spark, records, {(r["topic"], r["partition"]) for r in seen})
            known = positions_frame(spark, at)
            seeds = lookup(known.select(*KEYS, F.col("watermark_ms").alias("seed_ms")), rows=len(at))
            marked = watermark.with_watermark(records, self.now(), self.skew_ms, seeds, provider=self.provider)
            starts = [(t, p, x.offset if x else None, self.starts.get((t, p))) for (t, p), x in at.items()]
            done = lookup(spark.createDataFrame(starts, "topic string, partition int, __at bigint, __from bigint"), rows=len(starts))
            parted = marked.join(done, KEYS, "left").withColumn("__old", F.coalesce(F.col("offset") < F.col("__at"), F.lit(False)))
            if self.warm_up:
                again = F.lit(True) if self.rewind.is_zero else F.col("offset") >= F.coalesce("__from", "__at")
                self.warm_up(parted.filter(F.col("__old") & again).drop("__old", "__at", "__from"))
            fresh = routing.route(parted.filter(~F.col("__old")).drop("__old", "__at", "__from"), self.group())
            cut = self.strategy.cut(fresh, ["group_name"]).withColumnRenamed("batch", BATCH).persist()  # no batch without a limit
            try:
                self._commit_all(cut, at)
            finally:
                cut.unpersist()
        except BaseException:
            self.known.clear()  # what was committed is read again
            raise
        finally:
            records.unpersist()
            release(kept)

    def _commit_all(self, cut: DataFrame, at: dict[Key, Position | None]) -> None:
        # a row per group and topic partition, and one per group
        rows = ranges.build(cut, ["group_name"]).join(cut.groupBy("group_name", *KEYS).agg(F.count(F.lit(1)).alias("n")), ["group_name", *KEYS]).collect()
        batches = {r["group_name"]: r["n"] for r in cut.groupBy("group_name").agg((F.count_distinct(BATCH) if BATCH in cut.columns else F.lit(1)).alias("n")).collect()}
        groups: dict[str | None, list] = {}
        for r in rows:
            groups.setdefault(None if self.coalesce else r["group_name"], []).append(r)
        self.metrics.queued = len(groups)
        for group, parts in sorted(groups.items(), key=lambda x: x[0] or ""):
            covered = [Range(r["topic"], r["partition"], Position(r["start_offset"], r["start_watermark_ms"]), Position(r["end_offset"], r["end_watermark_ms"])) for r in parts]
            self.metrics.queued -= 1
            if is_committed(covered, at):
                self.metrics.skipped += 1
                continue
            mine = cut if group is None else cut.filter(F.col("group_name") == group)
            self._commit(self.formatter(mine.drop("group_name")), covered)
            n = sum(r["n"] for r in parts)
            self.metrics.polled += n
            self.metrics.batched += n
            self.metrics.batches += sum(batches.values()) if group is None else batches[group]
            self.known.update({(r.topic, r.partition): Position(r.end.offset + 1, r.end.watermark_ms) for r in covered})
            now = self.now()
            self.metrics.watermark_delay_ms |= {(r.topic, r.partition): now - r.end.watermark_ms for r in covered}
            self.metrics.source_delay_ms |= {(r.topic, r.partition): now - r.end.watermark_ms for r in covered}

    def _commit(self, rows: DataFrame, covered: list[Range]) -> None:
        began = time.time()
        keys = {(r.topic, r.partition) for r in covered}
        written: list[int] = []

        def missing() -> bool:
            self.storage.recover(keys)
            return not is_committed(covered, self.storage.committed_positions(keys))

        on_failure_if(self.retry, missing, lambda: written.append(self.storage.commit_batch(rows, covered) or 0))
        self.metrics.written += sum(written)
        self.metrics.commit_s.append(time.time() - began)

    def heartbeat(self) -> None:
        """On a quiet stream: delays grow, and on_heartbeat is called for every partition."""
        self.metrics.heartbeats += 1
        now = self.now()
        for (t, p), at in self.known.items():
            if at is not None:
                self.metrics.source_delay_ms[t, p] = now - at.watermark_ms
            if self.on_heartbeat:
                self.on_heartbeat(t, p)

    def trigger(self) -> dict:
        """The strategy's open time as the trigger; all there is, once, without one."""
        ms = self.strategy.interval_ms
        return {"availableNow": True} if ms is None else {"processingTime": f"{ms} milliseconds"}

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """trigger: as for writeStream.trigger; by default all there is, once."""
        self.build()
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def run(self, stream: DataFrame, checkpoint: str, stopped: Callable[[], bool] = lambda: False, poll_s: float = 0.2) -> None:
        """Runs with the strategy's trigger until all is read or stopped() holds; then lets the micro-batch at work finish."""
        beats = Heartbeats(self)
        spark = stream.sparkSession
        spark.streams.addListener(beats)
        query = self.start(stream, checkpoint, self.trigger())
        try:
            while not query.awaitTermination(poll_s):
                if stopped():
                    while query.isActive and query.status["isTriggerActive"]:
                        time.sleep(poll_s)
                    query.stop()
                    return
        finally:
            spark.streams.removeListener(beats)


class Wrapped:
    """Forwards to another ingest; a subclass adds to what it forwards."""

    def __init__(self, inner: Ingest | Wrapped):
        self.inner = inner

    def process(self, df: DataFrame, batch_id: int) -> None:
        self.inner.process(df, batch_id)

    def heartbeat(self) -> None:
        self.inner.heartbeat()

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ProgressListener(StreamingQueryListener):
    """Keeps rows and durations of a query's micro-batches."""

    def __init__(self):
        self.progress: deque[tuple[int, int, float]] = deque(maxlen=KEPT)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.progress.append((p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


class Heartbeats(ProgressListener):
    """Heartbeats of an ingest while its stream is quiet."""

    def __init__(self, ingest: Ingest | Wrapped):
        super().__init__()
        self.ingest = ingest

    def onQueryIdle(self, event):
        self.ingest.heartbeat()


def stream_log(spark: SparkSession, path: str, step: int = 0) -> DataFrame:
    spark.dataSource.register(logs.LogDataSource)
    reader = spark.readStream.format(logs.LogDataSource.name()).option("path", path)
    return (reader.option("step", step) if step else reader).load()

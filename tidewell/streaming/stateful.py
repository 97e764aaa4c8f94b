"""Watermarks and panes as state of a streaming query, carried from micro-batch to micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.commit.storage import Folder
from tidewell.model import KEYS
from tidewell.operators import late_events, watermark
from tidewell.session import lookup, staged
from tidewell.sources import log


class MarkedLog:
    """The running watermark across micro-batches, as a table on a shared file system.

    The state is the greatest watermark per topic partition.  Within a batch the
    maximum is taken by blocks of offsets, so a partition that holds most of it is
    no bottleneck.  Rows of a batch and the state after it appear by one rename."""

    def __init__(self, spark, path: str, now_ms: int, skew_ms: int = watermark.SKEW_MS):
        self.spark, self.now_ms, self.skew_ms = spark, now_ms, skew_ms
        self.folder = Folder(spark, path)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        at = self.folder.read_json("CURRENT") if self.folder.exists("CURRENT") else None
        if at and at["batch"] >= batch_id:
            return
        name = f"v{batch_id:012d}"
        marks = self.spark.read.parquet(self.folder.full(at["marks"])) if at else None
        rows = log.scan(batch.select(*KEYS, "offset", "timestamp_ms"))
        watermark.with_watermark(rows, self.now_ms, self.skew_ms, None if marks is None else lookup(marks, "marks")).write.mode("overwrite").parquet(self.folder.full(f"rows/{name}"))
        marked = self.spark.read.parquet(self.folder.full(f"rows/{name}")).groupBy(*KEYS).agg(F.max("watermark_ms").alias("seed_ms"))
        if marks is not None:
            marked = marked.unionByName(marks).groupBy(*KEYS).agg(F.max("seed_ms").alias("seed_ms"))
        marked.write.mode("overwrite").parquet(self.folder.full(f"marks/{name}"))
        self.folder.write("CURRENT", json.dumps({"batch": batch_id, "marks": f"marks/{name}", "rows": [*(at["rows"] if at else []), f"rows/{name}"]}), overwrite=True)

    def read(self) -> DataFrame | None:
        at = self.folder.read_json("CURRENT") if self.folder.exists("CURRENT") else None
        return self.spark.read.parquet(*[self.folder.full(r) for r in at["rows"]]) if at else None


#: Versions whose folders may hold live panes before a batch writes all of them anew.
MOST_VERSIONS = 16


class PaneStore:
    """Panes, watermarks and positions on a shared file system, corrected by every micro-batch.

    Three things make up the state: per topic partition the offset reached and
    the greatest watermark so far, and the panes.  A batch's records below the
    offset reached came before and count in nothing; the others meet the state's
    watermark or a greater one of their own batch.  Only panes that a batch
    touches are written, into the batch's folder; of a pane the latest folder
    that has it holds.  The pointer to all of it moves by one rename, so a
    replayed batch starts again from the state before it, or, if it was
    published, returns what it returned."""

    def __init__(self, spark, path: str, pane_ms: int = late_events.HOUR_MS, panes_per_window: int = 1, lateness_ms: int = late_events.LATENESS_MS):
        self.spark, self.pane_ms, self.panes_per_window, self.lateness_ms = spark, pane_ms, panes_per_window, lateness_ms
        self.folder = Folder(spark, path)

    def _pointer(self) -> dict | None:
        return self.folder.read_json("CURRENT") if self.folder.exists("CURRENT") else None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.full(path))

    def panes(self) -> DataFrame | None:
        at = self._pointer()
        if at is None:
            return None
        rest = [c for c in self._read(f"{at['versions'][-1]}/panes").columns if c not in ("topic", "pane_ms")]
        every = None
        for n, v in enumerate(at["versions"]):
            part = self._read(f"{v}/panes").withColumn("__v", F.lit(n))
            every = part if every is None else every.unionByName(part)
        return every.groupBy("topic", "pane_ms").agg(F.max_by(F.struct(*rest), "__v").alias("p")).select("topic", "pane_ms", "p.*")

    def marks(self) -> DataFrame | None:
        """(topic, partition, reached, seed_ms) so far."""
        at = self._pointer()
        return self._read(f"{at['versions'][-1]}/marks") if at and at.get("marks") else None

    def add_records(self, stream_record: DataFrame, test_table: DataFrame, batch_id: int) -> DataFrame:
        """Adds a batch of polled and stored records; returns the windows that changed.

        Records of a topic partition come in offset order from batch to batch."""
        at = self._pointer()
        if at and at["batch"] >= batch_id:
            return self._read(at["windows"])
        marks = self.marks()
        polled, stored, seeds = stream_record, test_table, None
        if marks is not None:
            known = lookup(marks, "marks")
            polled = polled.join(known.select("topic", "partition", "reached"), ["topic", "partition"], "left").filter("reached is null or offset > reached").drop("reached")
            own = known.select(F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), "reached")
            stored = stored.join(own, ["_topic", "_partition"], "left").filter("reached is null or _offset > reached").drop("reached")
            seeds = marks
        judged = staged(late_events.judged(polled, stored, self.lateness_ms, self.pane_ms, seeds), "judged")
        reached = judged.groupBy("topic", "partition").agg(F.max("offset").alias("reached"), F.max("wm_ms").alias("seed_ms"))
        if marks is not None:
            reached = reached.unionByName(marks).groupBy("topic", "partition").agg(F.max("reached").alias("reached"), F.max("seed_ms").alias("seed_ms"))
        return self.add(late_events.panes(judged), batch_id, reached)

    def add(self, delta: DataFrame, batch_id: int, marks: DataFrame | None = None) -> DataFrame:
        """Adds a batch's panes; returns the windows that changed."""
        at = self._pointer()
        if at and at["batch"] >= batch_id:
            return self._read(at["windows"])
        name = f"v{batch_id:012d}"
        # read more than once: by the merge, and for the windows it touches
        delta = staged(delta, "delta")
        touched = delta.select("topic", "pane_ms").distinct()
        before, fold = self.panes(), bool(at) and len(at["versions"]) >= MOST_VERSIONS
        merged = delta
        if before is not None:
            own = before if fold else before.join(touched, ["topic", "pane_ms"], "left_semi")
            merged = late_events.merge_panes(own, delta)
        merged.write.mode("overwrite").parquet(self.folder.full(f"{name}/panes"))
        if marks is not None:
            marks.write.mode("overwrite").parquet(self.folder.full(f"{name}/marks"))
        written = self._read(f"{name}/panes")
        now = written if before is None or fold else before.join(touched, ["topic", "pane_ms"], "left_anti").unionByName(written)
        changed = late_events.compose_windows(now, self.panes_per_window, self.pane_ms, changed=touched)
        changed.write.mode("overwrite").parquet(self.folder.full(f"{name}/windows"))
        versions = [name] if fold or not at else [*at["versions"], name]
        self.folder.write("CURRENT", json.dumps({"batch": batch_id, "versions": versions, "windows": f"{name}/windows", "marks": marks is not None}), overwrite=True)
        for old in at["versions"] if fold else ():
            self.folder.delete(old)
        return self._read(f"{name}/windows")

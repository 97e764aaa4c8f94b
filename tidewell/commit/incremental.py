"""Runs that process only new or changed records: output and saved tree appear together.

A run reads the table once for digests, which it stages in its folder.  The
digests of the leaves over them are compared with the saved tree from the roots
down; only records of changed leaves are compared.  The run's folder gets the
output, the record digests of changed leaves, and the whole tree, which says for
each leaf which run's folder holds its records; the pointer to all of it is one
atomic rename.  A run that fails before leaves the pointer as it was, so the next
one finds the same changes, and clears the folder left behind.

The table may grow while a run reads it: the output is taken from rows whose
digest is the staged one, and a run whose output lacks a pending record fails."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.commit.storage import Folder
from tidewell.operators import changes

#: Runs whose folders may hold live records before a run writes all of them anew.
MOST_FOLDERS = 16
_NODE = [*changes.KEYS, "node"]
_KEY = [*changes.KEYS, "_offset"]


class IncrementalRuns:
    def __init__(self, spark: SparkSession, base: str, columns: Sequence[str] = changes.CONTENT):
        self.spark, self.columns = spark, list(columns)
        self.folder = Folder(spark, base)

    def current_run(self) -> dict | None:
        return self.folder.read_json("CURRENT") if self.folder.exists("CURRENT") else None

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(self.folder.full(path))

    def _digested(self, table: DataFrame) -> DataFrame:
        """Rows with their digest: file id f, and a, b."""
        d = changes.content_digest(self.columns)
        return table.dropna(subset=_KEY).withColumn("__f", F.coalesce("_file_id", F.lit(changes.NO_FILE))).withColumn("__h", d)

    def _stage(self, table: DataFrame, path: str) -> None:
        """Digests of the current rows, once per record, and the leaves over them."""
        rows = self._digested(table).groupBy(*_KEY).agg(F.max(F.struct(F.col("__f").alias("f"), F.col("__h").alias("h"))).alias("r"))
        # by leaf, so that what belongs to one lies together and a leaf's digest is combined where it lies
        rows = rows.select(*_KEY, "r.f", "r.h.a", "r.h.b").repartition(*changes.KEYS, F.shiftright("_offset", 2 * changes.LEAF_BITS))
        rows.write.mode("overwrite").parquet(self.folder.full(f"{path}/now"))
        # a file id that only moved is no change of content
        same = self._read(f"{path}/now").withColumn("f", F.lit(0).cast("bigint")).withColumn("seen", F.lit(True))
        changes.leaves(same).select(*_NODE, F.col("current").alias("digest")).write.mode("overwrite").parquet(self.folder.full(f"{path}/leaves_now"))

    def _changed(self, path: str) -> DataFrame:
        """Leaves of the staged run that differ from the saved tree; all, without one."""
        leaves, run = self._read(f"{path}/leaves_now"), self.current_run()
        if run is None:
            return leaves.select(*_NODE)
        nothing = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("a", "b", "n")])
        old = self._read(f"{run['path']}/leaves").select(*_NODE, F.col("digest").alias("saved"))
        nodes = leaves.withColumnRenamed("digest", "current").join(old, _NODE, "full_outer")
        return changes.changed_leaves(changes.tree(nodes.select(*_NODE, F.coalesce("current", nothing).alias("current"), F.coalesce("saved", nothing).alias("saved"))))

    def _saved_records(self, changed: DataFrame) -> DataFrame | None:
        """Saved digests of the records of changed leaves, from the folders that hold them."""
        run = self.current_run()
        if run is None:
            return None
        home = self._read(f"{run['path']}/leaves").select(*_NODE, "run").join(changed, _NODE, "left_semi")
        parts = [self._read(f"{r}/records").withColumn("run", F.lit(r)) for r in run["folders"]]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.withColumn("node", F.shiftright("_offset", changes.LEAF_BITS)).join(home, [*_NODE, "run"], "left_semi").select(*_KEY, F.col("a").alias("sa"), F.col("b").alias("sb"))

    def _prepare(self, table: DataFrame) -> tuple[str, DataFrame]:
        """A run's folder with digests, changed leaves and pending records; and the latter."""
        path = f"runs/{uuid.uuid4().hex}"
        self._stage(table, path)
        self._changed(path).write.mode("overwrite").parquet(self.folder.full(f"{path}/changed"))
        changed = self._read(f"{path}/changed")
        now = changes.within(self._read(f"{path}/now"), changed)
        saved = self._saved_records(changed)
        new = now if saved is None else now.join(saved, _KEY, "left").filter("sa is null or sa != a or sb != b")
        new.select(*_KEY, "a", "b").write.mode("overwrite").parquet(self.folder.full(f"{path}/pending"))
        return path, self._read(f"{path}/pending")

    def pending(self, table: DataFrame) -> DataFrame:
        """(_topic, _partition, _offset) of records new or changed since the last published run."""
        return self._prepare(table)[1].select(*_KEY)

    def run(self, table: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Processes what is pending and publishes; returns the run's folder."""
        before = self.current_run()
        live = set(before["folders"]) | {before["path"]} if before else set()
        for name in self.folder.names("runs"):
            if f"runs/{name}" not in live:  # of a run that failed, or was only asked what is pending
                self.folder.delete(f"runs/{name}")
        path, pending = self._prepare(table)
        asked = pending.select(*_KEY, F.col("a").alias("__a"), F.col("b").alias("__b"))
        taken = self._digested(table).withColumn("__a", F.col("__h.a")).withColumn("__b", F.col("__h.b")).join(asked, [*_KEY, "__a", "__b"], "left_semi").drop("__f", "__h", "__a", "__b")
        if taken.select(*_KEY).distinct().count() != pending.count():
            raise RuntimeError("the table lost or changed records while the run read it; run again")
        process(taken).write.mode("overwrite").parquet(self.folder.full(f"{path}/output"))
        self._save(path, before)
        return path

    def _save(self, path: str, before: dict | None) -> None:
        everything = before is None or len(before["folders"]) >= MOST_FOLDERS
        now, changed = self._read(f"{path}/now"), self._read(f"{path}/changed")
        (now if everything else changes.within(now, changed)).write.mode("overwrite").parquet(self.folder.full(f"{path}/records"))
        leaves = self._read(f"{path}/leaves_now")
        if everything:
            tree = leaves.withColumn("run", F.lit(path))
        else:
            old = self._read(f"{before['path']}/leaves").select(*_NODE, F.col("run").alias("__old"))
            fresh = changed.withColumn("__new", F.lit(path))
            tree = leaves.join(fresh, _NODE, "left").join(old, _NODE, "left").withColumn("run", F.coalesce("__new", "__old")).drop("__new", "__old")
        tree.write.mode("overwrite").parquet(self.folder.full(f"{path}/leaves"))
        folders = [path] if everything else [*before["folders"], path]
        self.folder.write("CURRENT", json.dumps({"path": path, "folders": folders, "before": before and before["path"]}), overwrite=True)
        for name in ("now", "leaves_now", "changed"):
            self.folder.delete(f"{path}/{name}")

    def output(self) -> DataFrame | None:
        run = self.current_run()
        return self._read(f"{run['path']}/output") if run else None

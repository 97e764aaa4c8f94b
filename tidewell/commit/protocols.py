"""How a batch and the offsets it covers become visible together, or not at all."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.commit.ledger import Key, Ledger, Offset
from tidewell.commit.metadata import CommitMetadata, Staged, property_key
from tidewell.commit.storage import Folder
from tidewell.model import Position, Range
from tidewell.operators import positions
from tidewell.sources.files import ParquetConfig, stable_uuid

log = logging.getLogger(__name__)


class Storage(Protocol):
    """What the engine needs of a storage."""

    def recover(self, partitions: set[Key]) -> None: ...
    def committed_positions(self, partitions: set[Key]) -> dict[Key, Position | None]: ...
    def commit_batch(self, rows: DataFrame, ranges: list[Range]) -> int | None: ...  # rows written


def is_committed(ranges: list[Range], positions: dict[Key, Position | None]) -> bool:
    """Every range lies below its committed offset; watermarks don't matter."""
    return all((at := positions.get((r.topic, r.partition))) is not None and at.offset > r.end.offset for r in ranges)


def batch_token(ranges: list[Range]) -> str:
    return str(stable_uuid([(r.topic, r.partition, r.start.offset, r.end.offset) for r in ranges]))


#: Column by which the rows of a commit are split into file sets; no reader sees it.
BATCH = "__batch"
STORED = "stored_batch"


@dataclass(frozen=True)
class Layout:
    """How rows become files: format (parquet or orc), settings, partition columns,
    sort order within files, and the number of file sets' parts."""

    format: str = "parquet"
    parquet: ParquetConfig = ParquetConfig()
    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    files: int | None = None

    def __post_init__(self):
        if self.format not in ("parquet", "orc"):
            raise ValueError(f"no files of format {self.format!r}")

    def write(self, rows: DataFrame, path: str) -> int:
        """Writes rows; returns how many.  Rows of a batch lie in files of their own."""
        split = (BATCH, *self.partition_by) if BATCH in rows.columns else self.partition_by
        counted = Observation()
        out = rows.observe(counted, F.count(F.lit(1)).alias("n"))
        if split:
            # rows of a batch or partition come together, unless they are too many for a task: not every task writes a file in each
            out = out.hint("rebalance", *split)
        elif self.files:
            out = out.coalesce(self.files)
        if self.sort_by:
            out = out.sortWithinPartitions(*split, *self.sort_by)
        options = self.parquet.options() if self.format == "parquet" else {"compression": self.parquet.compression.parquet_codec}
        writer = out.write.mode("overwrite").options(**options).format(self.format)
        (writer.partitionBy(*split) if split else writer).save(path)
        return counted.get["n"]

    def read(self, spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
        back = spark.read.format(self.format).option("basePath", base).load(paths)
        return back.drop(*[c for c in (BATCH, STORED) if c in back.columns])


class TwoPhaseStorage:
    """Staged files, then staged offsets, then a rename, then the offsets.

    A failure before the offsets are staged leaves nothing; one after is
    finished by recover(): the staged folder is moved unless it already was,
    and the offsets are committed.  Readers see data/, where batches appear by
    rename only, and a replayed batch has the same name."""

    def __init__(self, spark: SparkSession, base: str, ledger: Ledger, layout: Layout = Layout()):
        self.spark, self.ledger, self.layout = spark, ledger, layout
        self.folder = Folder(spark, base)
        self.written = 0
        self.fail_at: str | None = None  # for tests of recovery

    def _maybe_fail(self, step: str) -> None:
        if self.fail_at == step:
            self.fail_at = None
            raise OSError(f"injected failure: {step}")

    def stage_batch(self, rows: DataFrame, ranges: list[Range]) -> list[dict[str, str]]:
        name = batch_token(ranges)
        self._maybe_fail("stage_files")
        self.written = self.layout.write(rows, self.folder.full(f"staging/{name}.tmp"))
        return [{"staged_file_path": f"staging/{name}.tmp", "destination_file_path": f"data/{STORED}={name}"}]

    def is_stored(self, staging: list[dict[str, str]]) -> bool:
        return all(self.folder.exists(s["destination_file_path"]) for s in staging)

    def store_batch(self, staging: list[dict[str, str]]) -> None:
        self._maybe_fail("store")
        for s in staging:
            if self.folder.exists(s["destination_file_path"]):
                continue
            if not self.folder.rename(s["staged_file_path"], s["destination_file_path"]) and not self.folder.exists(s["destination_file_path"]):
                raise OSError(f"{s['staged_file_path']} cannot be moved")

    def commit_batch(self, rows: DataFrame, ranges: list[Range]) -> int:
        staging = self.stage_batch(rows, ranges)
        self._maybe_fail("stage_offsets")
        self.ledger.commit({(r.topic, r.partition): Offset(r.start.offset, CommitMetadata(r.start.watermark_ms, Staged(staging, r.start, r.end)).serialize()) for r in ranges})
        self.store_batch(staging)
        self._maybe_fail("finalize")
        self._finalize({(r.topic, r.partition): r.end for r in ranges})
        return self.written

    def _finalize(self, ends: dict[Key, Position]) -> None:
        self.ledger.commit({k: Offset(e.offset + 1, CommitMetadata(e.watermark_ms).serialize()) for k, e in ends.items()})

    def recover(self, partitions: set[Key]) -> None:
        ends = {}
        for key, at in self.ledger.committed(partitions).items():
            meta = CommitMetadata.deserialize(at.metadata) if at and at.metadata else None
            if meta and meta.staged:
                if not self.is_stored(meta.staged.staging):
                    self.store_batch(meta.staged.staging)
                ends[key] = meta.staged.end
        self._finalize(ends)

    def committed_positions(self, partitions: set[Key]) -> dict[Key, Position | None]:
        out: dict[Key, Position | None] = {}
        for key, at in self.ledger.committed(partitions).items():
            meta = CommitMetadata.deserialize(at.metadata) if at and at.metadata else None
            out[key] = Position(at.offset, meta.watermark_ms if meta else 0) if at else None
        return out

    def read(self) -> DataFrame:
        back = self.spark.read.format(self.layout.format).load(self.folder.full("data"))
        return back.drop(*[c for c in (BATCH, STORED) if c in back.columns])


class TableStorage:
    """Data and offsets in one snapshot: a table of files named by manifests.

    Snapshot n lists the batches added since the last manifest, the manifests
    before, and all offset properties; it appears by one rename.  Every
    MANIFEST snapshots the list moves to a manifest, and older snapshots go, so
    a commit lists and reads a bounded number of entries.  Readers take the
    files from the last snapshot, so a folder that none names doesn't exist for
    them.  Offsets are then also put into the ledger, best effort."""

    #: Snapshots whose additions make up a manifest, and snapshots that are kept.
    MANIFEST = 20

    def __init__(self, spark: SparkSession, base: str, group: str, ledger: Ledger | None = None, layout: Layout = Layout()):
        self.spark, self.group, self.ledger, self.layout = spark, group, ledger, layout
        self.folder = Folder(spark, base)

    def _last(self) -> tuple[int, dict]:
        names = [n for n in self.folder.names("snapshots") if n.endswith(".json")]
        return (int(names[-1][:-5]), self.folder.read_json(f"snapshots/{names[-1]}")) if names else (-1, {"entries": [], "manifests": [], "properties": {}})

    def _publish(self, version: int, before: dict, entry: dict, properties: dict[str, str]) -> bool:
        """Snapshot version + 1 after before; False if another writer was first."""
        entries, manifests = [*before["entries"], entry], before["manifests"]
        if len(entries) > self.MANIFEST:
            name = f"manifests/{version + 1:012d}-{uuid.uuid4().hex}.json"
            self.folder.write(name, json.dumps(before["entries"]))
            entries, manifests = [entry], [*manifests, name]
        if not self.folder.write(f"snapshots/{version + 1:012d}.json", json.dumps({"entries": entries, "manifests": manifests, "properties": properties})):
            return False
        for old in self.folder.names("snapshots")[: -self.MANIFEST]:
            self.folder.delete(f"snapshots/{old}")
        return True

    def _entries(self) -> list[dict]:
        _, last = self._last()
        return [e for m in last["manifests"] for e in self.folder.read_json(m)] + last["entries"]

    def recover(self, partitions: set[Key]) -> None:
        """Nothing is ever half done."""

    def commit_batch(self, rows: DataFrame, ranges: list[Range]) -> int:
        name = batch_token(ranges)
        path = f"data/{STORED}={name}"
        n = self.layout.write(rows, self.folder.full(path))
        mine = {property_key(self.group, r.topic, r.partition): f"{r.end.offset}:{r.end.watermark_ms}" for r in ranges}
        while True:
            version, last = self._last()
            if self._publish(version, last, {"added": path}, last["properties"] | mine):
                break
        if self.ledger:
            try:
                self.ledger.commit({(r.topic, r.partition): Offset(r.end.offset + 1, json.dumps({"watermark": r.end.watermark_ms})) for r in ranges})
            except Exception:
                log.exception("offsets are in the table but not in the ledger")
        return n

    def committed_positions(self, partitions: set[Key]) -> dict[Key, Position | None]:
        properties = self._last()[1]["properties"]
        out: dict[Key, Position | None] = {}
        for t, p in partitions:
            text = properties.get(property_key(self.group, t, p))
            out[(t, p)] = Position(int(text.split(":")[0]) + 1, int(text.split(":")[1])) if text else None
        return out

    def read(self) -> DataFrame | None:
        paths = list(dict.fromkeys(e["added"] for e in self._entries()))
        return self.layout.read(self.spark, self.folder.full("data"), [self.folder.full(p) for p in paths]) if paths else None


class InRowStorage(TableStorage):
    """Rows carry their own topic, partition, offset and watermark; positions are
    read from the rows, for all consumer groups.  The engine asks once per
    partition after a start, and holds them from then on."""

    def __init__(self, *args, columns: tuple[str, str, str, str] = ("_topic", "_partition", "_offset", "_watermark"), **kw):
        super().__init__(*args, **kw)
        self.columns = columns

    def committed_positions(self, partitions: set[Key]) -> dict[Key, Position | None]:
        table = self.read()
        out: dict[Key, Position | None] = dict.fromkeys(partitions)
        if table is None:
            return out
        t, p, o, w = (F.col(c) for c in self.columns)
        # one row per asked partition: as many as the log has partitions
        rows = table.filter(t.isNotNull() & p.isNotNull()).groupBy(t.alias("t"), p.alias("p")).agg((F.max(o) + 1).alias("o"), F.max(F.unix_millis(w.cast("timestamp"))).alias("w")).collect()
        return out | {(r["t"], r["p"]): Position(r["o"], r["w"] or 0) for r in rows if (r["t"], r["p"]) in partitions}


class ExternalOffsetStorage(TableStorage):
    """Rows carry a file id; the offsets of each file are rows of a second table.
    One snapshot adds both.  Positions are those of this consumer group."""

    def next_file_id(self) -> int:
        """The id of the next file: one more than snapshots so far, so a replay that lost its snapshot uses it again."""
        return self._last()[0] + 2

    def commit_batch(self, rows: DataFrame, ranges: list[Range]) -> int:
        name = batch_token(ranges)
        while True:
            version, last = self._last()
            file_id = version + 2
            data, offsets = f"data/{STORED}={name}-{file_id}", f"offsets/{name}-{file_id}"
            n = self.layout.write(rows.withColumn("_file_id", F.lit(file_id).cast("bigint")), self.folder.full(data))
            own = [(file_id, self.group, r.topic, r.partition, r.start.offset, r.start.watermark_ms, r.end.offset, r.end.watermark_ms) for r in ranges]
            table = self.spark.createDataFrame(own, "_file_id bigint, _consumer_group string, _topic string, _partition int, _start_offset bigint, s bigint, _end_offset bigint, e bigint")
            table.select(
                "_file_id", "_consumer_group", "_topic", "_partition", "_start_offset", F.timestamp_millis("s").cast("timestamp_ntz").alias("_start_watermark"),
                "_end_offset", F.timestamp_millis("e").cast("timestamp_ntz").alias("_end_watermark"),
            ).coalesce(1).write.mode("overwrite").parquet(self.folder.full(offsets))
            if self._publish(version, last, {"added": data, "offsets": offsets}, last["properties"]):
                return n

    def offsets(self) -> DataFrame | None:
        paths = [e["offsets"] for e in self._entries()]
        return self.spark.read.parquet(*[self.folder.full(p) for p in paths]) if paths else None

    def committed_positions(self, partitions: set[Key]) -> dict[Key, Position | None]:
        table = self.offsets()
        out: dict[Key, Position | None] = dict.fromkeys(partitions)
        if table is None:
            return out
        found = positions.external(table, self.group).collect()  # one row per topic partition of the group
        return out | {(r["topic"], r["partition"]): Position(r["offset"], r["watermark_ms"]) for r in found if (r["topic"], r["partition"]) in partitions}


class MultipartStorage(TwoPhaseStorage):
    """Two-phase commits as object stores have them: staging uploads the parts of
    an object under an upload id, storing completes the upload.  Whether an
    object is stored is asked by its exact key.  Emulated on a file system."""

    def __init__(self, *args, key: Callable[[list[Range]], str] = batch_token, **kw):
        super().__init__(*args, **kw)
        self.key = key

    def stage_batch(self, rows: DataFrame, ranges: list[Range]) -> list[dict[str, str]]:
        self._maybe_fail("stage_files")
        key, upload = self.key(ranges), batch_token(ranges)
        self.written = self.layout.write(rows, self.folder.full(f"uploads/{upload}/part-1"))
        return [{"id": upload, "part_tag": "part-1", "key": key}]

    def is_stored(self, staging: list[dict[str, str]]) -> bool:
        return all(self.folder.exists(f"data/{s['key']}") for s in staging)

    def store_batch(self, staging: list[dict[str, str]]) -> None:
        self._maybe_fail("store")
        for s in staging:
            if self.folder.exists(f"data/{s['key']}"):
                continue
            if not self.folder.rename(f"uploads/{s['id']}/{s['part_tag']}", f"data/{s['key']}"):
                raise OSError(f"upload {s['id']} cannot be completed")
            self.folder.delete(f"uploads/{s['id']}")

    def read(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").format(self.layout.format).load(self.folder.full("data"))


def recover_ledger(intents: DataFrame) -> DataFrame:
    """(topic, partition, offset, watermark_ms, staged, stored, end_offset, end_watermark_ms)
    to the ledger after recovery, and store: which batches recovery has to store."""
    done = F.col("staged")
    return intents.select(
        "topic", "partition",
        F.when(done, F.col("end_offset") + 1).otherwise(F.col("offset")).alias("offset"),
        F.when(done, F.col("end_watermark_ms")).otherwise(F.coalesce("watermark_ms", F.lit(0))).alias("watermark_ms"),
        (done & ~F.col("stored")).alias("store"),
    )

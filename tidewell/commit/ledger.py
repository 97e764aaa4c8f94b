"""Committed offsets with metadata, per consumer group: one atomic entry per commit."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewell.commit.storage import Folder
from tidewell.model import POSITIONS, Position

Key = tuple[str, int]


@dataclass(frozen=True)
class Offset:
    offset: int
    metadata: str = ""


class Ledger:
    """Versions 000…n.json, each with all offsets of the group; the last one holds.

    commit() is atomic over all partitions given; a concurrent writer makes it
    read again and retry."""

    def __init__(self, spark: SparkSession, path: str, group: str):
        self.spark, self.group = spark, group
        self.folder = Folder(spark, f"{path.rstrip('/')}/{group}")

    def _last(self) -> tuple[int, dict[str, list]]:
        names = [n for n in self.folder.names() if n.endswith(".json")]
        return (int(names[-1][:-5]), self.folder.read_json(names[-1])) if names else (-1, {})

    def committed(self, partitions: set[Key] | None = None) -> dict[Key, Offset | None]:
        _, rows = self._last()
        known = {(t, int(p)): Offset(*v) for k, v in rows.items() for t, _, p in [k.rpartition(":")]}
        return known if partitions is None else {k: known.get(k) for k in partitions}

    def commit(self, offsets: dict[Key, Offset]) -> None:
        while True:
            version, rows = self._last()
            rows = rows | {f"{t}:{p}": [o.offset, o.metadata] for (t, p), o in offsets.items()}
            if self.folder.write(f"{version + 1:012d}.json", json.dumps(rows)):
                for old in self.folder.names()[:-20]:
                    if old.endswith(".json"):
                        self.folder.delete(old)
                return


def positions_frame(spark: SparkSession, positions: dict[Key, Position | None]) -> DataFrame:
    rows = [(t, p, x.offset, x.watermark_ms) if x else (t, p, None, None) for (t, p), x in sorted(positions.items())]
    return spark.createDataFrame(rows, POSITIONS)

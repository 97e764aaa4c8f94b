"""When to close files and cut batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators import scan

DEFAULT_RECORDS = 1000


@dataclass(frozen=True)
class AnyOf:
    """Reached once any given limit is: open time, bytes or records."""

    open_ms: int | None = None
    size: int | None = None
    records: int | None = None

    def __post_init__(self):
        if self.open_ms is None and self.size is None and self.records is None:
            raise ValueError("at least one limit is needed")

    def column(self, open_ms: Column, size: Column, records: Column) -> Column:
        tests = [c >= limit for c, limit in ((open_ms, self.open_ms), (size, self.size), (records, self.records)) if limit is not None]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return F.coalesce(out, F.lit(False))

    def cut(self, records: DataFrame, group: Sequence[str]) -> DataFrame:
        """Adds batch, see cut()."""
        return cut(records, group, self.records, self.size)

    @property
    def interval_ms(self) -> int | None:
        """Batches are open for a micro-batch, so open time is the trigger's interval."""
        return self.open_ms

    def reached(self, open_ms: int, size: Callable[[], int], records: int) -> bool:
        """size is a function, so that it is asked only if needed."""
        return (
            (self.open_ms is not None and open_ms >= self.open_ms)
            or (self.records is not None and records >= self.records)
            or (self.size is not None and size() >= self.size)
        )


@dataclass
class FuzzyAnyOf:
    """Limits drawn from Gaussians (mean, deviation), drawn anew after each cut,
    so that many loaders don't cut at once.  size is asked every size_every-th
    call only; the count starts again with a cut.  Holds state: one per sink."""

    open_ms: tuple[float, float] | None = None
    size: tuple[float, float] | None = None
    records: tuple[float, float] | None = None
    size_every: int | None = None
    seed: int | None = None
    _calls: int = field(default=0, init=False)

    def __post_init__(self):
        if self.open_ms is None and self.size is None and self.records is None:
            raise ValueError("at least one limit is needed")
        self._random = np.random.default_rng(self.seed)
        self._draw()

    def _draw(self) -> None:
        pick = lambda d: None if d is None else int(self._random.normal(d[0], d[1]))
        self._limits = (pick(self.open_ms), pick(self.size), pick(self.records))

    def cut(self, records: DataFrame, group: Sequence[str]) -> DataFrame:
        """Adds batch by the limits drawn, which are drawn anew afterwards."""
        _, size, n = self._limits
        self._draw()
        return cut(records, group, n and max(1, n), size and max(1, size))

    @property
    def interval_ms(self) -> int | None:
        return self._limits[0]

    def reached(self, open_ms: int, size: Callable[[], int], records: int) -> bool:
        self._calls += 1
        t, s, n = self._limits
        done = (t is not None and open_ms >= t) or (n is not None and records >= n)
        if not done and s is not None and (self.size_every is None or self._calls >= self.size_every):
            self._calls = 0 if self.size_every is not None else self._calls
            done = size() >= s
        if done:
            self._calls = 0
            self._draw()
        return done


def any_file(stats: DataFrame, by: Sequence[str], strategy: AnyOf) -> DataFrame:
    """(by…, ready): some file of the batch has reached the limit."""
    return stats.groupBy(*by).agg(F.bool_or(strategy.column(F.col("open_ms"), F.col("size"), F.col("records"))).alias("ready"))


def all_files(stats: DataFrame, by: Sequence[str], strategy: AnyOf) -> DataFrame:
    """(by…, ready): every file has; a batch without files has no row and counts as ready."""
    return stats.groupBy(*by).agg(F.bool_and(strategy.column(F.col("open_ms"), F.col("size"), F.col("records"))).alias("ready"))


def total(stats: DataFrame, by: Sequence[str], strategy: AnyOf) -> DataFrame:
    """(by…, open_ms, size, records, ready): longest open time, summed size and records against the limit."""
    sums = stats.groupBy(*by).agg(F.max("open_ms").alias("open_ms"), F.sum("size").alias("size"), F.sum("records").alias("records"))
    return sums.withColumn("ready", strategy.column(F.col("open_ms"), F.col("size"), F.col("records")))


def _size() -> Column:
    """Bytes of a record: its key and value."""
    return F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))


def cut(records: DataFrame, group: Sequence[str], n: int | None = None, size: int | None = None) -> DataFrame:
    """Adds batch: records of a group, in order of (timestamp_ms, topic, partition,
    offset), cut so that no batch has more than n records, nor begins a record
    beyond size bytes.  Cut by ranges, as ranks are; without a limit there is no batch."""
    order = ["timestamp_ms", "topic", "partition", "offset"]
    sums = ({"__n": F.lit(1).cast("bigint")} if n else {}) | ({"__b": _size().cast("bigint")} if size else {})
    if not sums:
        return records
    counted = scan.running_sums(records, group, order, sums)
    # both terms never fall, and their sum grows where either does
    terms = ([F.floor(F.col("__n") / n)] if n else []) + ([F.floor(F.col("__b") / size)] if size else [])
    return counted.withColumn("batch", sum(terms[1:], terms[0]).cast("bigint")).drop(*sums)


def cut_by_count(records: DataFrame, group: Sequence[str], n: int = DEFAULT_RECORDS) -> DataFrame:
    """Adds batch: records of a group, in order of (timestamp_ms, topic, partition,
    offset), cut every n.  Ranked by ranges of that order, so neither a group nor
    one time (records without any, say) is one task."""
    ranked = scan.running_count(records, group, ["timestamp_ms", "topic", "partition", "offset"], "__rank")
    return ranked.withColumn("batch", F.floor(F.col("__rank") / n).cast("bigint")).drop("__rank")

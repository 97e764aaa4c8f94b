"""Records, positions, ranges and intervals of the log, as Spark types."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["topic", "partition"]
#: A watermark before any record; survives as a number.
NO_WATERMARK = -1

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "binary": T.BinaryType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(), "array<int>": T.ArrayType(T.IntegerType()), "decimal(18,6)": T.DecimalType(18, 6)}


def struct(text: str) -> T.StructType:
    """'name type, …' of the log's own types, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.split() for part in re.split(r", ", text))])


RECORD = struct("topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, watermark_ms bigint")
POSITION = struct("offset bigint, watermark_ms bigint")
RANGE = struct("topic string, partition int, start_offset bigint, start_watermark_ms bigint, end_offset bigint, end_watermark_ms bigint")
POSITIONS = struct("topic string, partition int, offset bigint, watermark_ms bigint")
FILE_STATS = struct("open_ms bigint, size bigint, records bigint")


@total_ordering
@dataclass(frozen=True)
class Position:
    """Ordered by offset only."""

    offset: int
    watermark_ms: int = 0

    def __lt__(self, other: Position) -> bool:
        return self.offset < other.offset


@dataclass(frozen=True)
class Range:
    """Both ends inclusive."""

    topic: str
    partition: int
    start: Position
    end: Position

    def merge(self, other: Range) -> Range:
        """The hull of two ranges of one topic partition, the later one second."""
        if (self.topic, self.partition) != (other.topic, other.partition):
            raise ValueError("ranges of different topic partitions do not merge")
        return Range(self.topic, self.partition, self.start, other.end)


@dataclass(frozen=True)
class OffsetInterval:
    length: int

    @property
    def is_zero(self) -> bool:
        return self.length == 0


@dataclass(frozen=True)
class WatermarkInterval:
    ms: int

    @property
    def is_zero(self) -> bool:
        return self.ms == 0


def format_ms(ms: Column, pattern: str) -> Column:
    """UTC text of a time in milliseconds; null before the epoch."""
    return F.when(ms >= 0, F.date_format(F.timestamp_millis(ms), pattern))


def date_of_ms(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))

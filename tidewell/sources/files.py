"""Codecs, Parquet settings, paths of files, and reading files back."""

from __future__ import annotations

import bz2
import gzip
import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from enum import Enum

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ranges import token


class Compression(Enum):
    NONE = ("none", None)
    ZSTD = ("zstd", "zst")
    GZIP = ("gzip", "gz")
    BZIP = ("bzip", "bz2")
    SNAPPY = ("snappy", "snappy")
    LZ4 = ("lz4", "lz4")

    @property
    def extension(self) -> str | None:
        return self.value[1]

    @classmethod
    def parse(cls, name: str) -> Compression | None:
        return next((c for c in cls if c.value[0] == name.lower()), None)

    @property
    def text_codec(self) -> str:
        """The name Spark's text and CSV writers have for it; zstd has none there."""
        if self is Compression.ZSTD:
            raise ValueError("Spark's text writers have no zstd: use write_lines")
        return {"bzip": "bzip2"}.get(self.value[0], self.value[0])

    @property
    def parquet_codec(self) -> str:
        if self is Compression.BZIP:
            raise ValueError("Parquet has no bzip")
        return self.value[0]


#: Codecs that the load commands of the databases cannot read.
REFUSED = {"clickhouse": {Compression.SNAPPY}, "vertica": {Compression.SNAPPY, Compression.LZ4}}


def check_codec(target: str, compression: Compression) -> Compression:
    if compression in REFUSED.get(target, ()):
        raise ValueError(f"{target} cannot load {compression.value[0]}")
    return compression


@dataclass(frozen=True)
class ParquetConfig:
    compression: Compression = Compression.ZSTD
    block_size: int | None = None
    page_size: int | None = None
    page_rows: int | None = None
    dictionary: bool | None = None
    dictionary_page_size: int | None = None
    writer_version: str | None = None
    bloom_filter: bool | None = None
    byte_stream_split: bool | None = None

    def options(self) -> dict[str, str]:
        named = {
            "parquet.block.size": self.block_size, "parquet.page.size": self.page_size, "parquet.page.row.count.limit": self.page_rows,
            "parquet.enable.dictionary": self.dictionary, "parquet.dictionary.page.size": self.dictionary_page_size,
            "parquet.writer.version": self.writer_version, "parquet.bloom.filter.enabled": self.bloom_filter,
            "parquet.enable.bytestreamsplit": self.byte_stream_split,
        }
        show = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return {"compression": self.compression.parquet_codec} | {k: show(v) for k, v in named.items() if v is not None}


def stable_uuid(ranges: Sequence[tuple[str, int, int, int]]) -> uuid.UUID:
    """Names a file by its (topic, partition, start, end) ranges: a replay of a
    batch gives the same name and overwrites, never duplicates."""
    text = ";".join(f"{t}:{p}:{s}:{e}" for t, p, s, e in sorted(ranges))
    return uuid.UUID(bytes=hashlib.md5(text.encode()).digest())


def uuid7(now_ms: int | None = None) -> uuid.UUID:
    """A time-ordered random name.  Never where a replay must find the same name."""
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    raw = bytearray(ms.to_bytes(6, "big") + os.urandom(10))
    raw[6] = raw[6] & 0x0F | 0x70
    raw[8] = raw[8] & 0x3F | 0x80
    return uuid.UUID(bytes=bytes(raw))


def uuid_column(ranges: Column) -> Column:
    """The same name as a column; ranges: array of structs (topic, partition, start_offset, end_offset)."""
    texts = F.transform(F.sort_array(ranges), lambda r: token(r["topic"], r["partition"], r["start_offset"], r["end_offset"]))
    h = F.md5(F.array_join(texts, ";").cast("binary"))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))


@dataclass(frozen=True)
class TimePaths:
    """'<formatted date>/<uuid>[.ext]', a pure function of partition and ranges."""

    pattern: str | None = "'dt='yyyyMMdd"
    extension: str | None = None

    def column(self, day: Column | None, ranges: Column) -> Column:
        name = uuid_column(ranges)
        if self.extension:
            name = F.concat(name, F.lit(f".{self.extension}"))
        return name if self.pattern is None else F.concat(F.date_format(day, self.pattern), F.lit("/"), name)


def compressor(compression: Compression) -> Callable[[bytes], bytes]:
    if compression is Compression.NONE:
        return bytes
    if compression is Compression.ZSTD:
        return zstandard.ZstdCompressor(write_content_size=True).compress
    if compression is Compression.GZIP:
        return lambda b: gzip.compress(b, mtime=0)
    if compression is Compression.BZIP:
        return bz2.compress
    return _frame(compression.value[0])


def file_contents(rows: DataFrame, by: Sequence[str], column: str, order: Sequence[str], header: bytes = b"", compression: Compression = Compression.NONE, footer: bytes = b"") -> DataFrame:
    """(by…, content, size, records): encoded rows of each file in order, between header and footer; size is that after compression.

    Files are cut before by a commit strategy, so each is bounded."""
    packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(column).alias("__row")))).alias("p"))
    packed = packed.select(*by, F.transform("p", lambda r: r["__row"]).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = compressor(compression)
        for b in batches:
            parts = b.column(len(by)).to_pylist()
            content = [squeeze(header + b"".join(p) + footer) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(by)], pa.array(content, pa.binary()), pa.array([len(c) for c in content], pa.int64()), pa.array([len(p) for p in parts], pa.int64())],
                [*by, "content", "size", "records"],
            )

    schema = ", ".join([*[f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in by], "content binary, size bigint, records bigint"])
    return packed.mapInArrow(run, schema)


def decompressed(rows: DataFrame, compression: Compression) -> DataFrame:
    """(path, content) with the contents as they were before compression."""
    if compression is Compression.NONE:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = {Compression.ZSTD: lambda b: zstandard.ZstdDecompressor().stream_reader(b, read_across_frames=True).read(), Compression.GZIP: gzip.decompress, Compression.BZIP: bz2.decompress, Compression.SNAPPY: _unframe("snappy"), Compression.LZ4: _unframe("lz4")}[compression]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([expand(x) for x in b.column(1).to_pylist()], pa.binary())], ["path", "content"])

    return rows.select("path", "content").mapInArrow(run, "path string, content binary")


def _unframe(codec: str) -> Callable[[bytes], bytes]:
    """A stream of that codec as pyarrow reads it; snappy: its length, then one block."""
    if codec == "snappy":
        return lambda b: pa.decompress(b[8:], int.from_bytes(b[:8], "big"), codec="snappy", asbytes=True)
    return lambda b: pa.CompressedInputStream(pa.BufferReader(b), codec).read()


def _frame(codec: str) -> Callable[[bytes], bytes]:
    if codec == "snappy":
        return lambda b: len(b).to_bytes(8, "big") + pa.compress(b, codec="snappy", asbytes=True)

    def lz4(b: bytes) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, codec) as out:
            out.write(b)
        return sink.getvalue().to_pybytes()

    return lz4


def read_parquet(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(base)


def read_lines(spark: SparkSession, base: str) -> DataFrame:
    """Lines 'topic;partition;offset;watermark;content'; the content may hold ';'."""
    parts = F.split("value", ";", 5)
    return spark.read.option("recursiveFileLookup", "true").text(base).select(
        parts[0].alias("topic"), parts[1].cast("int").alias("partition"), parts[2].cast("bigint").alias("offset"), parts[3].cast("bigint").alias("watermark_ms"), parts[4].alias("content")
    )

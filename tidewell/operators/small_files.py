"""Consolidating small files: the plan, the rows it moves, and the bytes.

Method: byte-level concatenation.  Newline-delimited files are joined with a
line break where a file lacks its last one and with repeated headers dropped;
complete zstandard frames are joined as they are, since a sequence of frames
decompresses to the sequence of contents.  Nothing is parsed or decompressed
but where a checksum of the content is asked for: frames are walked by their
block headers, so one cut short is refused; lengths and checksums recorded of a
part are compared with what is read, and the file written with what was joined.

Defined results: a file's size is that of its last report that gives one, its
record count that of its last report; a file without a size is left alone; of
reports with the same time the greater figures stand; a null file id or path
drops the row; a path without '/' lies in the directory ''; columns of the
table named directory or target give way to the plan's; empty tables give no
rows.
"""

from __future__ import annotations

import hashlib
import io
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import lookup

SMALL_BYTES = 16_384
AIM_BYTES = 262_144
_BITS = 12


def latest_reports(file_stats: DataFrame) -> DataFrame:
    """(_file_id, directory, size, records): what is last known of each file."""
    last = file_stats.filter("_file_id is not null and file_path is not null").groupBy("_file_id").agg(
        F.max(F.struct("reported_at", F.coalesce("records_written", F.lit(-1)).alias("n"), "file_path")).alias("l"),
        F.max(F.when(F.col("file_size").isNotNull(), F.struct("reported_at", "file_size")))["file_size"].alias("size"),
    )
    return last.select("_file_id", F.regexp_extract("l.file_path", "^(.*)/", 1).alias("directory"), "size", F.col("l.n").alias("records"))


def to_merge(file_stats: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """(_file_id, directory, size, records): small files that have a small neighbour."""
    files = latest_reports(file_stats).filter((F.col("size") < small) & (F.col("records") > 0))
    crowded = files.groupBy("directory").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("directory")
    return files.join(lookup(crowded, "crowded"), "directory", "left_semi").select("_file_id", "directory", "size", "records")


def plan(file_stats: DataFrame, aim: int = AIM_BYTES, small: int = SMALL_BYTES) -> DataFrame:
    """(directory, target, _file_id, size, records, begins): which files form target
    number target of their directory, and the byte at which each begins.

    Files follow each other in order of file id; a target closes at the file
    that reaches aim, so all but a directory's last are filled to aim and at
    most small bytes beyond.  The running size is taken by blocks of file ids:
    no task sees a whole directory."""
    files = to_merge(file_stats, small).withColumn("__b", F.shiftright("_file_id", _BITS)).withColumn("__sb", F.shiftright("__b", _BITS))
    blocks = files.groupBy("directory", "__sb", "__b").agg(F.sum("size").alias("__n"))
    supers = blocks.groupBy("directory", "__sb").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy("directory").orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    supers = supers.select("directory", "__sb", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s0"))
    within = Window.partitionBy("directory", "__sb").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("__s1", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(supers, ["directory", "__sb"])
    starts = starts.select("directory", "__b", (F.col("__s0") + F.col("__s1")).alias("__s"))
    own = Window.partitionBy("directory", "__b").orderBy("_file_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.join(starts, ["directory", "__b"]).withColumn("__at", F.col("__s") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    target = F.floor(F.col("__at") / aim).cast("bigint")
    return placed.select("directory", target.alias("target"), "_file_id", "size", "records", F.col("__at").alias("begins"))


def regroup(test_table: DataFrame, file_stats: DataFrame, aim: int = AIM_BYTES) -> DataFrame:
    """Every row of test_table once, with directory and target of its file (null: not merged)."""
    moves = lookup(plan(file_stats, aim).select(F.col("_file_id").alias("__f"), "directory", "target"), "moves")
    rows = test_table.drop("__f", "directory", "target")
    filed = rows.filter("_file_id is not null").join(moves, F.col("_file_id") == F.col("__f"), "left").drop("__f")
    # rows without a file, however many, stay where they are: as join keys their nulls would all meet in one task
    loose = rows.filter("_file_id is null").withColumn("directory", F.lit(None).cast("string")).withColumn("target", F.lit(None).cast("bigint"))
    return filed.unionByName(loose)


_FRAMES = "_file_id bigint, frame binary, rows bigint, plain_bytes bigint, crc bigint"


def frames(lines: DataFrame) -> DataFrame:
    """(_file_id, place, line) to one zstandard frame of newline-delimited text
    per file.  A file is at most SMALL_BYTES by its statistics, so its lines fit a task."""
    packed = lines.groupBy("_file_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    text = packed.select("_file_id", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("t"), F.size("l").cast("bigint").alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for b in batches:
            plain = [x.encode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([c.compress(x) for x in plain], pa.binary()), b.column(2), pa.array([len(x) for x in plain], pa.int64()), pa.array([zlib.crc32(x) for x in plain], pa.int64())],
                ["_file_id", "frame", "rows", "plain_bytes", "crc"],
            )

    return text.mapInArrow(run, _FRAMES)


def whole_frames(part: bytes) -> int:
    """How many zstandard frames a part consists of; raises unless it ends with a whole one.

    Reads headers only: frame header, block headers, the flag of the checksum."""
    at, n = 0, 0

    def need(k: int) -> int:
        if at + k > len(part):
            raise ValueError("a zstandard frame is cut short")
        return at + k

    while at < len(part):
        magic = part[at : need(4)]
        at += 4
        if 0x184D2A50 <= int.from_bytes(magic, "little") <= 0x184D2A5F:  # skippable
            size = int.from_bytes(part[at : need(4)], "little")
            at += 4
            at = need(size)
            continue
        if magic != b"\x28\xb5\x2f\xfd":
            raise ValueError("not a zstandard frame")
        need(1)
        flags = part[at]
        single = flags >> 5 & 1
        at = need(1 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6])
        last = False
        while not last:
            head = int.from_bytes(part[at : need(3)], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            at += 3
            if kind == 3:
                raise ValueError("a block of reserved type")
            at = need(1 if kind == 1 else size)
        if flags & 4:
            at = need(4)
        n += 1
    return n


def join_bytes(parts: list[bytes], kind: str, plain: list[tuple[int, int]] | None = None, header_lines: int = 0, recorded: list[tuple[int | None, int | None]] | None = None) -> bytes:
    """parts as one file.  kind: lines (newline-delimited, header_lines of which
    stand in every part) or zstd (each part whole frames).

    recorded: length and crc32 of each part's bytes as known beforehand, None if
    not; plain: those of each part's decompressed content.  A difference raises."""
    for part, (size, crc) in zip(parts, recorded or [(None, None)] * len(parts), strict=True):
        if (size is not None and len(part) != size) or (crc is not None and zlib.crc32(part) != crc):
            raise ValueError("a part is not what was recorded of it")
    if kind == "zstd":
        for part in parts:
            whole_frames(part)
        if plain is not None:
            for part, (size, crc) in zip(parts, plain, strict=True):
                content = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(part), read_across_frames=True).read()
                if len(content) != size or zlib.crc32(content) != crc:
                    raise ValueError("a part does not hold the content it was planned with")
        return b"".join(parts)
    if kind != "lines":
        raise ValueError(f"unknown kind {kind!r}")
    out = bytearray()
    header = None
    spared = added = 0  # bytes of headers left out, of line breaks put in
    for part in parts:
        body = part
        if header_lines:
            ends = [i + 1 for i, c in zip(range(len(part)), part) if c == 10][:header_lines]
            cut = ends[-1] if len(ends) == header_lines else len(part)
            head, body = part[:cut], part[cut:]
            if head.strip():
                whole = head if head.endswith(b"\n") else head + b"\n"
                if header is None:
                    header = whole
                    added += len(whole) - len(head)
                    out += whole
                elif whole != header:
                    raise ValueError("parts have different headers")
                else:
                    spared += len(head)
            else:
                spared += len(head)
        out += body
        if body and not body.endswith(b"\n"):
            out += b"\n"
            added += 1
    if len(out) != sum(map(len, parts)) - spared + added:
        raise ValueError("the joined file has not the length of its parts")
    return bytes(out)


def located(base: str):
    """File system and path of a URI or local path, in any process."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(base) if "://" in base else (fs.LocalFileSystem(), base) if not base.startswith("file:") else (fs.LocalFileSystem(), base.removeprefix("file:"))


def write_once(base: str, name: str, content: bytes) -> str:
    """Writes base/name under a temporary name, reads it back, compares, and renames;
    a retried or concurrent task replaces the same content."""
    files, root = located(base)
    final = f"{root.rstrip('/')}/{name}"
    files.create_dir(os.path.dirname(final), recursive=True)
    temporary = f"{os.path.dirname(final)}/.{os.path.basename(final)}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary, compression=None) as f:
        f.write(content)
    with files.open_input_stream(temporary, compression=None) as f:
        back = f.read()
    if len(back) != len(content) or zlib.crc32(back) != zlib.crc32(content):
        raise OSError(f"{final}: what was written differs")
    files.move(temporary, final)
    return final


def write_files(contents: DataFrame, base: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """contents: (name, content).  Writes each as a file below base; returns (name, bytes, crc) and the bigint columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = b.column(1).to_pylist()
            for name, blob in zip(b.column(0).to_pylist(), blobs, strict=True):
                write_once(base, name, blob)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in blobs], pa.int64()), pa.array([zlib.crc32(x) for x in blobs], pa.int64()), *b.columns[2:]], ["name", "bytes", "crc", *keep])

    return contents.select("name", "content", *keep).mapInArrow(run, ", ".join(["name string, bytes bigint, crc bigint", *[f"{c} bigint" for c in keep]]))


def concat_files(moves: DataFrame, source: str, destination: str, kind: str, header_lines: int = 0) -> DataFrame:
    """Joins files on any file system that pyarrow knows.  moves: (directory, target,
    path, place), optionally bytes and crc, which the part read must have.

    A target's parts are read where it is written; returns (directory, target,
    path, files, bytes, crc).  A target is bounded by its plan."""
    known = [c if c in moves.columns else F.lit(None).cast("bigint").alias(c) for c in ("bytes", "crc")]
    parts = moves.select("directory", "target", "place", "path", *known)
    grouped = parts.groupBy("directory", "target").agg(F.sort_array(F.collect_list(F.struct("place", "path", "bytes", "crc"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(source)
        for b in batches:
            rows = []
            for directory, target, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                blobs = []
                for p in parts:
                    with files.open_input_stream(f"{root.rstrip('/')}/{p['path']}", compression=None) as f:
                        blobs.append(f.read())
                whole = join_bytes(blobs, kind, header_lines=header_lines, recorded=[(p["bytes"], p["crc"]) for p in parts])
                final = write_once(destination, f"{directory}/part-{target:06d}", whole)
                rows.append((directory, target, final, len(blobs), len(whole), zlib.crc32(whole)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                ["directory", "target", "path", "files", "bytes", "crc"],
            )

    return grouped.mapInArrow(run, "directory string, target bigint, path string, files bigint, bytes bigint, crc bigint")


def contents(joined: DataFrame) -> DataFrame:
    """joined, as concat_files returns it, with lines and md5 of what each file holds, read back and decompressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, digests = [], []
            for path in b.column(2).to_pylist():
                files, at = located(path)
                with files.open_input_stream(at, compression=None) as f:
                    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
                lines.append(plain.count(b"\n"))
                digests.append(hashlib.md5(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(lines, pa.int64()), pa.array(digests, pa.string())], ["directory", "target", "files", "lines", "content"])

    return joined.mapInArrow(run, "directory string, target bigint, files bigint, lines bigint, content string")

"""Two-phase commits of files in formats of their own: text, CSV, RowBinary, native rows.

A batch's rows are encoded by expressions, put together to files by Arrow
batches, compressed, and written by any task that pyarrow's file systems allow.
A file is named by the batch it belongs to, so a replay writes it again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.commit.protocols import BATCH, STORED, TwoPhaseStorage, batch_token
from tidewell.encode import csv, native, rowbinary
from tidewell.model import Range
from tidewell.operators import small_files
from tidewell.sources import files
from tidewell.sources.files import Compression

#: Rows of a table as the bytes of one column.
Encoder = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FileBuilder:
    """How rows become a file's bytes: row (a binary column), header, footer, codec, extension."""

    row: Callable[[], Column]
    header: bytes = b""
    footer: bytes = b""
    compression: Compression = Compression.NONE
    extension: str = "dat"

    @property
    def suffix(self) -> str:
        codec = self.compression.extension
        return f".{self.extension}.{codec}" if codec else f".{self.extension}"

    def build(self, rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """(by…, content, size, records): a file per value of by, its rows in order of their bytes; size after compression."""
        encoded = rows.select(*by, self.row().alias("__bytes"))
        return files.file_contents(encoded, by, "__bytes", ["__bytes"], self.header, self.compression, self.footer)


def lines(text: Callable[[], Column], compression: Compression = Compression.NONE, extension: str = "txt", header: str = "") -> FileBuilder:
    """Newline-delimited text."""
    return FileBuilder(lambda: F.encode(F.concat(text(), F.lit("\n")), "utf-8"), header.encode(), b"", compression, extension)


def csv_files(schema: T.StructType, fmt: csv.CsvFormat = csv.CsvFormat(), compression: Compression = Compression.NONE) -> FileBuilder:
    header = fmt.separator.join(schema.names) + "\n" if fmt.header else ""
    return lines(lambda: csv.line(schema, fmt), compression, "csv", header)


def rowbinary_files(schema: T.StructType, compression: Compression = Compression.NONE) -> FileBuilder:
    return FileBuilder(lambda: rowbinary.row(schema), compression=compression, extension="rowbinary")


def native_files(schema: T.StructType, compression: Compression = Compression.NONE) -> FileBuilder:
    return FileBuilder(lambda: native.row(schema), native.header(schema), b"", compression, "native")


class FormatStorage(TwoPhaseStorage):
    """Two-phase commits of built files.

    folder: the folder within the batch that a row's file lies in (a time path,
    say).  Rows of a batch, marked by the engine's cuts, make up a file per
    folder; without cuts a commit makes up one, so commits are to be bounded."""

    def __init__(self, spark, base: str, ledger, builder: FileBuilder, folder: Callable[[], Column] | None = None):
        super().__init__(spark, base, ledger)
        self.builder, self.folder_of = builder, folder

    def stage_batch(self, rows: DataFrame, ranges: list[Range]) -> list[dict[str, str]]:
        self._maybe_fail("stage_files")
        name = batch_token(ranges)
        placed = rows.withColumn("__folder", self.folder_of() if self.folder_of else F.lit(""))
        if BATCH not in placed.columns:
            placed = placed.withColumn(BATCH, F.lit(0).cast("bigint"))
        built = self.builder.build(placed, ("__folder", BATCH))
        file = F.concat_ws("/", F.when(F.col("__folder") != "", F.col("__folder")), F.concat(F.lit(f"{name}-"), F.col(BATCH).cast("string"), F.lit(self.builder.suffix)))
        written = small_files.write_files(built.select(file.alias("name"), "content", "records"), self.folder.full(f"staging/{name}.tmp"), ("records",))
        self.written = written.agg(F.sum("records")).first()[0] or 0
        self._folder_exists(name)
        return [{"staged_file_path": f"staging/{name}.tmp", "destination_file_path": f"data/{STORED}={name}"}]

    def _folder_exists(self, name: str) -> None:
        """A batch without rows is a folder without files."""
        if not self.folder.exists(f"staging/{name}.tmp"):
            self.folder.make(f"staging/{name}.tmp")

    def read(self) -> DataFrame:
        """(path, content): the files' decompressed bytes, path below the batch's folder."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder.full("data"))
        tail = F.regexp_extract("path", f"{STORED}=[^/]*/(.*)$", 1)
        return files.decompressed(raw.select(tail.alias("path"), "content"), self.builder.compression)

    def read_lines(self) -> DataFrame:
        """(path, line) of text files."""
        text = F.decode("content", "utf-8")
        return self.read().select("path", F.explode(F.split(F.regexp_replace(text, "\n$", ""), "\n")).alias("line"))

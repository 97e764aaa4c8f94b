"""Statements that load files into databases (text only: no database is reached here)."""

from __future__ import annotations

from enum import Enum

from tidewell.model import Range
from tidewell.sources.files import Compression, check_codec


class LoadMethod(Enum):
    AUTO = "AUTO"
    DIRECT = "DIRECT"
    TRICKLE = "TRICKLE"

    @classmethod
    def parse(cls, text: str) -> LoadMethod:
        try:
            return cls[text.upper()]
        except KeyError:
            raise ValueError(f"unknown load method {text!r}") from None


_WORDS = {Compression.NONE: "", Compression.ZSTD: "ZSTD", Compression.GZIP: "GZIP", Compression.BZIP: "BZIP"}


def _codec(compression: Compression) -> str:
    check_codec("vertica", compression)
    return f" {_WORDS[compression]}" if _WORDS[compression] else ""


def copy_csv(table: str, path: str, compression: Compression, method: LoadMethod, separator: str = "\t", header: bool = False) -> str:
    shown = "E'\\\\t'" if separator == "\t" else f"'{separator}'"
    skip = " SKIP 1" if header else ""
    return f"COPY {table} FROM LOCAL '{path}'{_codec(compression)} DELIMITER {shown}{skip} ABORT ON ERROR {method.value} NO COMMIT"


def copy_native(table: str, path: str, compression: Compression, method: LoadMethod) -> str:
    return f"COPY {table} FROM LOCAL '{path}'{_codec(compression)} NATIVE ABORT ON ERROR {method.value} NO COMMIT"


def insert_settings(ranges: list[Range], rows: int) -> dict[str, str]:
    """One block per file, named by its ranges, so that a repeated insert is dropped."""
    name = ";".join(f"{r.topic}:{r.partition}:{r.start.offset}:{r.end.offset}" for r in ranges)
    return {"max_insert_block_size": str(rows), "insert_deduplication_token": name}


def position_query(table: str, topic: str = "_topic", partition: str = "_partition", offset: str = "_offset", watermark: str = "_watermark") -> str:
    return f"SELECT {topic}, {partition}, MAX({offset}) + 1, MAX({watermark}) FROM {table} WHERE {topic} IS NOT NULL AND {partition} IS NOT NULL GROUP BY {topic}, {partition}"

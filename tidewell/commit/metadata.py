"""What is committed beside an offset: watermark, and staging while a commit is under way."""

from __future__ import annotations

import base64
import binascii
import json
import logging
from dataclasses import dataclass
from typing import Any

import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.model import Position

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Staged:
    staging: Any
    start: Position
    end: Position


@dataclass(frozen=True)
class CommitMetadata:
    watermark_ms: int
    staged: Staged | None = None

    def to_json(self) -> str:
        out: dict[str, Any] = {"watermark": self.watermark_ms}
        if self.staged:
            s = self.staged
            out["staged"] = {"staging": s.staging, "start_offset": s.start.offset, "start_watermark": s.start.watermark_ms, "end_offset": s.end.offset, "end_watermark": s.end.watermark_ms}
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    def serialize(self) -> str:
        return base64.b64encode(zstandard.ZstdCompressor(write_content_size=True).compress(self.to_json().encode())).decode()

    @staticmethod
    def from_json(text: str) -> CommitMetadata | None:
        try:
            d = json.loads(text)
            s = d.get("staged")
            numbers = [d["watermark"], *([s[k] for k in ("start_offset", "start_watermark", "end_offset", "end_watermark")] if s else [])]
            if not all(isinstance(n, int) and not isinstance(n, bool) for n in numbers):
                raise ValueError("offsets and watermarks are whole numbers")
            staged = Staged(s["staging"], Position(s["start_offset"], s["start_watermark"]), Position(s["end_offset"], s["end_watermark"])) if s else None
            return CommitMetadata(d["watermark"], staged)
        except (ValueError, KeyError, TypeError, AttributeError):
            log.exception("commit metadata cannot be parsed")
            return None

    @staticmethod
    def deserialize(text: str) -> CommitMetadata | None:
        """Compressed and base64, or plain JSON; None if neither."""
        try:
            raw = base64.b64decode(text, validate=True)
        except (binascii.Error, ValueError):
            return CommitMetadata.from_json(text)
        try:
            return CommitMetadata.from_json(zstandard.ZstdDecompressor().decompress(raw).decode())
        except (zstandard.ZstdError, UnicodeDecodeError):
            log.exception("commit metadata cannot be decompressed")
            return None


_JSON = "struct<watermark:bigint,staged:struct<staging:string,start_offset:bigint,start_watermark:bigint,end_offset:bigint,end_watermark:bigint>>"


def json_column(watermark: Column, staging: Column | None = None, start: Column | None = None, start_wm: Column | None = None, end: Column | None = None, end_wm: Column | None = None) -> Column:
    if staging is None:
        return F.to_json(F.struct(watermark.alias("watermark")))
    staged = F.struct(staging.alias("staging"), start.alias("start_offset"), start_wm.alias("start_watermark"), end.alias("end_offset"), end_wm.alias("end_watermark"))
    return F.to_json(F.struct(watermark.alias("watermark"), staged.alias("staged")))


def parsed(column: Column) -> Column:
    return F.from_json(column, _JSON)


def property_value(offset: Column, watermark: Column) -> Column:
    """'<end offset>:<watermark>', as a table property."""
    return F.concat_ws(":", offset.cast("string"), watermark.cast("string"))


def property_position(text: Column) -> Column:
    """The position after such a property: its offset + 1."""
    parts = F.split(text, ":")
    return F.struct((parts[0].cast("bigint") + 1).alias("offset"), parts[1].cast("bigint").alias("watermark_ms"))


def property_key(group: str, topic: str, partition: int) -> str:
    """The name is a fixed value of the format."""
    return f"__consumer_offset:{group}:{topic}:{partition}"

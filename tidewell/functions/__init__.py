"""Column functions for use in one's own plans: bytes, texts, times, names."""

from tidewell.encode.binary import cut_bytes, cut_utf8, decimal, fixed_bytes, fixed_utf8, le_float32, le_float64, le_floats, le_int, leb128, scaled_int, uuid_bytes
from tidewell.encode.csv import line as csv_line
from tidewell.model import date_of_ms, format_ms
from tidewell.operators.formatting import bucket, date_path, truncate, truncate_int
from tidewell.sources.files import uuid_column

__all__ = [
    "bucket", "csv_line", "cut_bytes", "cut_utf8", "date_of_ms", "date_path", "decimal", "fixed_bytes", "fixed_utf8", "format_ms", "le_float32", "le_float64", "le_floats", "le_int", "leb128", "scaled_int",
    "truncate", "truncate_int", "uuid_bytes", "uuid_column",
]

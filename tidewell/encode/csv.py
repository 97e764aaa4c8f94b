"""Rows as delimited text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSS"


@dataclass(frozen=True)
class CsvFormat:
    """Tab-separated without a header; nulls are empty."""

    separator: str = "\t"
    header: bool = False
    null: str = ""
    timestamp: str = TIMESTAMP

    def options(self) -> dict[str, str]:
        return {"sep": self.separator, "header": str(self.header).lower(), "nullValue": self.null, "emptyValue": "", "escape": '"', "timestampFormat": self.timestamp}


def text(f: T.StructField, x: Column, fmt: CsvFormat = CsvFormat()) -> Column:
    """A value as text, null as null."""
    t = f.dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(x, fmt.timestamp)
    if isinstance(t, T.ArrayType):
        return F.array_join(x, ";")
    if isinstance(t, (T.StructType, T.MapType, T.BinaryType)):
        raise ValueError(f"{f.name}: no text for {t.simpleString()}")
    return x.cast("string")


def line(schema: T.StructType, fmt: CsvFormat = CsvFormat()) -> Column:
    """A row's text without quoting, for values known to hold no separators."""
    return F.concat_ws(fmt.separator, *[F.coalesce(text(f, F.col(f"`{f.name}`"), fmt), F.lit(fmt.null)) for f in schema.fields])


def as_text(df: DataFrame, fmt: CsvFormat = CsvFormat()) -> DataFrame:
    """All columns as texts, ready for write.csv(**options)."""
    return df.select(*[text(f, F.col(f"`{f.name}`"), fmt).alias(f.name) for f in df.schema.fields])

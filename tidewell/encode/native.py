"""Rows with size, null bitmap and values, after a header of column sizes (the native bulk format)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.encode import binary, fields, writer

#: First bytes of a file, fixed values.
MAGIC = bytes([0x4E, 0x41, 0x54, 0x49, 0x56, 0x45, 0x0A, 0xFF, 0x0D, 0x0A, 0x00])
MOST_BYTES = 65_000
VARIABLE = -1


def size_of(f: T.StructField) -> int:
    fields.check(f)
    t, meta = f.dataType, f.metadata or {}
    sizes = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 8, T.DoubleType: 8, T.DateType: 8, T.TimestampType: 8, T.TimestampNTZType: 8}
    if type(t) in sizes:
        return sizes[type(t)]
    if isinstance(t, T.DecimalType):
        return (fields.decimal_of(f)[0] // 19 + 1) * 8
    if isinstance(t, (T.StringType, T.BinaryType)):
        if meta.get("uuid"):
            return 16
        for key in ("fixed_length", "max_length"):
            if meta.get(key, 0) > MOST_BYTES:
                raise ValueError(f"{f.name}: at most {MOST_BYTES} bytes")
        return meta.get("fixed_length", VARIABLE)
    raise ValueError(f"{f.name}: no encoding for {t.simpleString()}")


def header(schema: T.StructType) -> bytes:
    sizes = [size_of(f) for f in schema.fields]
    body = writer.integer(1, 2) + b"\0" + writer.integer(len(sizes), 2) + b"".join(writer.integer(s, 4) for s in sizes)
    return MAGIC + writer.integer(len(body), 4) + body


def _value(f: T.StructField, x: Column) -> Column:
    t, meta = f.dataType, f.metadata or {}
    truncate = meta.get("truncate", True)
    if isinstance(t, T.BooleanType):
        return binary.le_int(x.cast("int"), 1)
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return binary.le_int(x, size_of(f))
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return binary.le_float64(x.cast("double"))
    if isinstance(t, T.DecimalType):
        return binary.decimal(x, *fields.decimal_of(f))
    if isinstance(t, T.DateType):
        return binary.le_int(F.unix_date(x) - binary.NATIVE_EPOCH_DAYS, 8)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return binary.le_int(F.unix_micros(x.cast("timestamp")) - binary.NATIVE_EPOCH_US, 8)
    text = isinstance(t, T.StringType)
    if meta.get("uuid"):
        return binary.uuid_bytes(x)
    if "fixed_length" in meta:
        n = meta["fixed_length"]
        return binary.fixed_utf8(x, n, truncate) if text else binary.fixed_bytes(x, n, truncate)
    most = meta.get("max_length", MOST_BYTES)
    raw = binary.cut_utf8(x, most, truncate) if text else binary.cut_bytes(x, most, truncate)
    return F.concat(binary.le_int(F.octet_length(raw), 4), raw)


def null_bits(schema: T.StructType) -> Column:
    """One bit a column, the first in the highest bit of the first byte."""
    out = []
    for at in range(0, len(schema.fields), 8):
        bits = F.lit(0)
        for i, f in enumerate(schema.fields[at : at + 8]):
            bits = bits + F.when(F.col(f"`{f.name}`").isNull(), 1 << (7 - i)).otherwise(0)
        out.append(binary.le_int(bits, 1))
    return F.concat(*out)


def row(schema: T.StructType) -> Column:
    """Size of the values alone, null bitmap, values; a null has no bytes."""
    parts = [F.coalesce(_value(f, F.col(f"`{f.name}`")), F.lit(b"")) for f in schema.fields]
    values = F.concat(*parts)
    return F.concat(binary.le_int(F.octet_length(values), 4), null_bits(schema), values)


def encode(df: DataFrame, schema: T.StructType, out: str = "row") -> DataFrame:
    for f in schema.fields:
        size_of(f)
    return df.withColumn(out, row(schema))

"""Rows as concatenated values without a header (the RowBinary format)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.encode import binary, fields


def _present(f: T.StructField, x: Column) -> Column:
    t, meta = f.dataType, f.metadata or {}
    truncate = meta.get("truncate", True)
    if isinstance(t, T.BooleanType):
        return binary.le_int(x.cast("int"), 1)
    if isinstance(t, T.ByteType):
        return binary.le_int(x, 1)
    if isinstance(t, T.ShortType):
        return binary.le_int(x, 2)
    if isinstance(t, T.IntegerType):
        return binary.le_int(x, 4)
    if isinstance(t, T.LongType):
        return binary.le_int(x, 8)
    if isinstance(t, T.FloatType):
        return binary.le_float32(x)
    if isinstance(t, T.DoubleType):
        return binary.le_float64(x)
    if isinstance(t, T.DecimalType):
        return binary.decimal(x, *fields.decimal_of(f))
    if isinstance(t, T.DateType):
        return binary.le_int(F.unix_date(x), 2)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return binary.le_int(F.unix_seconds(x.cast("timestamp")), 4)
    if isinstance(t, (T.StringType, T.BinaryType)):
        text = isinstance(t, T.StringType)
        if meta.get("uuid"):
            raw = binary.uuid_bytes(x)
            return F.concat(binary.reversed_bytes(F.substring(raw, 1, 8), 8), binary.reversed_bytes(F.substring(raw, 9, 8), 8))
        if "fixed_length" in meta:
            n = meta["fixed_length"]
            return binary.fixed_utf8(x, n, truncate, b"\0") if text else binary.fixed_bytes(x, n, truncate)
        raw = binary.utf8(x) if text else x
        if "max_length" in meta:
            raw = binary.cut_utf8(x, meta["max_length"], truncate) if text else binary.cut_bytes(x, meta["max_length"], truncate)
        return F.concat(binary.leb128(F.octet_length(raw)), raw)
    if isinstance(t, T.ArrayType):
        item = T.StructField("item", t.elementType, t.containsNull)
        if isinstance(t.elementType, T.ArrayType) and isinstance(t.elementType.elementType, T.ArrayType):
            raise ValueError(f"{f.name}: arrays nest two levels at most")
        if isinstance(t.elementType, (T.FloatType, T.DoubleType)):
            # a nullable element begins with a byte, see value()
            return F.concat(binary.leb128(F.size(x)), binary.le_floats(x, isinstance(t.elementType, T.DoubleType), t.containsNull))
        # the aggregate's accumulator starts with the count
        return F.aggregate(x, binary.leb128(F.size(x)), lambda acc, e: F.concat(acc, value(item, e)))
    if isinstance(t, T.StructType):
        return F.concat(*[value(g, x[g.name]) for g in t.fields])
    raise ValueError(f"{f.name}: no encoding for {t.simpleString()}")


def value(f: T.StructField, x: Column) -> Column:
    """A field's bytes: a nullable one begins with 0, or is just 1 if null."""
    fields.check(f)
    if isinstance(f.dataType, (T.ArrayType, T.StructType)):
        return _present(f, x)  # composites cannot be null
    return F.when(x.isNull(), F.lit(b"\x01")).otherwise(F.concat(F.lit(b"\0"), _present(f, x))) if f.nullable else _present(f, x)


def row(schema: T.StructType) -> Column:
    return F.concat(*[value(f, F.col(f"`{f.name}`")) for f in schema.fields])


def encode(df: DataFrame, schema: T.StructType, out: str = "row") -> DataFrame:
    return df.withColumn(out, row(schema))

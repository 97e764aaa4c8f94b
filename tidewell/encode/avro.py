"""Avro binary payloads as typed rows, without a schema registry; for Arrow batches.

Schemas are JSON: records of null, boolean, int, long, float, double, bytes,
string, enum, fixed, arrays, maps, nested records, unions of null and one other,
and the logical types date, timestamp-millis, timestamp-micros, decimal and uuid."""

from __future__ import annotations

import datetime
import decimal
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_EPOCH = datetime.datetime(1970, 1, 1)
_PLAIN = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "enum": T.StringType(), "fixed": T.BinaryType()}


def _parts(schema) -> tuple[str, dict, bool, int]:
    """(kind, attributes, nullable, place of null in the union)."""
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1 or len(schema) != 2:
            raise ValueError("unions are of null and one other")
        kind, attributes, _, _ = _parts(rest[0])
        return kind, attributes, True, schema.index("null")
    return (schema, {}, False, -1) if isinstance(schema, str) else (schema["type"], schema, False, -1) if isinstance(schema["type"], str) else _parts(schema["type"])


def spark_type(schema) -> tuple[T.DataType, bool]:
    """The Spark type of an Avro schema, and whether it may be null."""
    kind, a, nullable, _ = _parts(schema)
    logical = a.get("logicalType")
    if kind == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in a["fields"]]), nullable
    if kind == "array":
        return T.ArrayType(*spark_type(a["items"])), nullable
    if kind == "map":
        return T.MapType(T.StringType(), *spark_type(a["values"])), nullable
    if logical == "decimal":
        return T.DecimalType(a["precision"], a.get("scale", 0)), nullable
    named = {"date": T.DateType(), "timestamp-millis": T.TimestampNTZType(), "timestamp-micros": T.TimestampNTZType(), "uuid": T.StringType()}
    if logical in named:
        return named[logical], nullable
    if kind not in _PLAIN:
        raise ValueError(f"no type for {kind!r}")
    return _PLAIN[kind], nullable


def struct_of(schema: str) -> T.StructType:
    """The Spark schema of an Avro record, for files with the same columns."""
    out = spark_type(json.loads(schema))[0]
    if not isinstance(out, T.StructType):
        raise ValueError("a record is needed")
    return out


def _long(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return (n >> 1) ^ -(n & 1), at
        shift += 7


def _blob(raw: bytes, at: int) -> tuple[bytes, int]:
    n, at = _long(raw, at)
    if n < 0 or at + n > len(raw):
        raise ValueError("cut short")
    return raw[at : at + n], at + n


Reader = Callable[[bytes, int], tuple[object, int]]


def _blocks(raw: bytes, at: int, one: Callable[[int], int]) -> int:
    while True:
        n, at = _long(raw, at)
        if n == 0:
            return at
        if n < 0:  # with the block's size in bytes
            n = -n
            _, at = _long(raw, at)
        for _ in range(n):
            at = one(at)


def reader(schema) -> Reader:
    """A function from (bytes, place) to (value, place after it)."""
    kind, a, nullable, null_at = _parts(schema)
    logical = a.get("logicalType")
    if kind == "null":
        base: Reader = lambda r, i: (None, i)
    elif kind == "boolean":
        base = lambda r, i: (r[i] == 1, i + 1)
    elif kind in ("int", "long"):
        turn = {
            "date": lambda n: (_EPOCH + datetime.timedelta(days=n)).date(), "timestamp-millis": lambda n: _EPOCH + datetime.timedelta(milliseconds=n), "timestamp-micros": lambda n: _EPOCH + datetime.timedelta(microseconds=n),
        }.get(logical)

        def base(r, i):
            n, i = _long(r, i)
            return (turn(n) if turn else n), i
    elif kind == "float":
        base = lambda r, i: (struct.unpack_from("<f", r, i)[0], i + 4)
    elif kind == "double":
        base = lambda r, i: (struct.unpack_from("<d", r, i)[0], i + 8)
    elif kind in ("bytes", "fixed"):
        size, scale = a.get("size"), a.get("scale", 0)

        def base(r, i):
            raw, i = (r[i : i + size], i + size) if kind == "fixed" else _blob(r, i)
            return (decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-scale) if logical == "decimal" else raw), i
    elif kind == "string":

        def base(r, i):
            raw, i = _blob(r, i)
            return raw.decode(), i
    elif kind == "enum":

        def base(r, i):
            n, i = _long(r, i)
            return a["symbols"][n], i
    elif kind == "array":
        item = reader(a["items"])

        def base(r, i):
            out: list = []

            def one(at: int) -> int:
                v, at = item(r, at)
                out.append(v)
                return at

            return out, _blocks(r, i, one)
    elif kind == "map":
        value = reader(a["values"])

        def base(r, i):
            pairs: dict = {}

            def one(at: int) -> int:
                k, at = _blob(r, at)
                pairs[k.decode()], at = value(r, at)
                return at

            i = _blocks(r, i, one)
            return list(pairs.items()), i
    elif kind == "record":
        fields = [(f["name"], reader(f["type"])) for f in a["fields"]]

        def base(r, i):
            row = {}
            for name, f in fields:
                row[name], i = f(r, i)
            return row, i
    else:
        raise ValueError(f"no reader for {kind!r}")
    if not nullable:
        return base

    def optional(r, i):
        n, i = _long(r, i)
        return (None, i) if n == null_at else base(r, i)

    return optional


def payload(schema: str, value: str = "value", strict: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A formatter: the payload's fields take the place of value.  A null payload, and
    unless strict one that cannot be read whole, gives no row."""
    read = reader(json.loads(schema))
    fields = struct_of(schema)

    def run(records: DataFrame) -> DataFrame:
        kept = [f for f in records.schema.fields if f.name != value]
        if {f.name for f in kept} & set(fields.names):
            raise ValueError("the payload has fields of the record's names")
        out = T.StructType([*kept, *[T.StructField(f.name, f.dataType, True) for f in fields.fields]])
        names = [f.name for f in kept]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(out)
            for b in batches:
                at, rows = [], []
                for i, raw in enumerate(b.column(value).to_pylist()):
                    if raw is None:
                        continue
                    try:
                        row, end = read(raw, 0)
                        if end != len(raw):
                            raise ValueError("bytes are left over")
                    except (ValueError, IndexError, struct.error, OverflowError):
                        if strict:
                            raise
                        continue
                    at.append(i)
                    rows.append(row)
                take = pa.array(at, pa.int64())
                arrays = [b.column(n).take(take).cast(target.field(n).type) for n in names] + [pa.array([r[f] for r in rows], target.field(f).type) for f in fields.names]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

        return records.mapInArrow(decode, out)

    return run

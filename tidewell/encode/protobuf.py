"""Protocol buffer payloads as typed rows, by field numbers; for Arrow batches.

A message is a list of (number, name, kind): kind is one of the scalar types of
the language, "repeated <kind>", or a nested list.  Absent scalars have their
default, as in version 3; absent messages are null; unknown fields are skipped."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Message = list[tuple[int, str, Any]]
_INT32, _INT64 = ("int32", "sint32", "sfixed32", "uint32", "fixed32"), ("int64", "sint64", "sfixed64", "uint64", "fixed64")
_DEFAULTS = {"bool": False, "string": "", "bytes": b"", "float": 0.0, "double": 0.0}


def spark_type(kind) -> T.DataType:
    if isinstance(kind, list):
        return struct_of(kind)
    if kind.startswith("repeated "):
        return T.ArrayType(spark_type(kind[9:]), False)
    if kind in ("uint32", "fixed32"):
        return T.LongType()
    named = {"bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "float": T.FloatType(), "double": T.DoubleType()}
    if kind in named:
        return named[kind]
    if kind in _INT32:
        return T.IntegerType()
    if kind in _INT64:
        return T.LongType()
    raise ValueError(f"no type for {kind!r}")


def struct_of(message: Message) -> T.StructType:
    """The Spark schema of a message, for files with the same columns."""
    return T.StructType([T.StructField(name, spark_type(kind), True) for _, name, kind in message])


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n & (1 << 64) - 1, at
        shift += 7


def _signed(n: int, bits: int) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> bits - 1 else n


def _scalar(kind: str, wire: int, raw: bytes, at: int) -> tuple[Any, int]:
    """A value and the place after it."""
    if wire == 0:
        n, at = _varint(raw, at)
        if kind == "bool":
            return n != 0, at
        if kind in ("sint32", "sint64"):
            return (n >> 1) ^ -(n & 1), at
        return (n & 0xFFFFFFFF if kind == "uint32" else _signed(n, 32 if kind == "int32" else 64)), at
    code = {"float": "<f", "double": "<d", "fixed32": "<I", "sfixed32": "<i", "fixed64": "<q", "sfixed64": "<q"}[kind]
    return struct.unpack_from(code, raw, at)[0], at + struct.calcsize(code)


def reader(message: Message) -> Callable[[bytes], dict[str, Any]]:
    known = {n: (name, kind[9:] if isinstance(kind, str) and kind.startswith("repeated ") else kind, isinstance(kind, str) and kind.startswith("repeated ")) for n, name, kind in message}
    nested = {n: reader(kind) for n, _, kind in message if isinstance(kind, list)}
    empty = {name: [] if many else None if isinstance(kind, list) else _DEFAULTS.get(kind, 0) for name, kind, many in known.values()}

    def read(raw: bytes) -> dict[str, Any]:
        row = {k: list(v) if isinstance(v, list) else v for k, v in empty.items()}
        at = 0
        while at < len(raw):
            tag, at = _varint(raw, at)
            number, wire = tag >> 3, tag & 7
            if wire == 2:
                size, at = _varint(raw, at)
                if at + size > len(raw):
                    raise ValueError("cut short")
                body, at = raw[at : at + size], at + size
            elif wire not in (0, 1, 5):
                raise ValueError(f"wire type {wire}")
            if number not in known:
                at = at if wire == 2 else _varint(raw, at)[1] if wire == 0 else at + (8 if wire == 1 else 4)
                continue
            name, kind, many = known[number]
            if wire == 2 and number in nested:
                value: Any = nested[number](body)
            elif wire == 2 and kind in ("string", "bytes"):
                value = body.decode() if kind == "string" else body
            elif wire == 2 and many:  # packed
                i, packed = 0, 5 if kind in ("float", "fixed32", "sfixed32") else 1 if kind in ("double", "fixed64", "sfixed64") else 0
                while i < len(body):
                    value, i = _scalar(kind, packed, body, i)
                    row[name].append(value)
                continue
            elif wire == 2:
                raise ValueError(f"{name}: not a {kind}")
            else:
                value, at = _scalar(kind, wire, raw, at)
            if many:
                row[name].append(value)
            else:
                row[name] = value
        return row

    return read


def payload(message: Message, value: str = "value", strict: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A formatter: the message's fields take the place of value.  A null payload, and
    unless strict one that cannot be read, gives no row."""
    fields = struct_of(message)

    def run(records: DataFrame) -> DataFrame:
        kept = [f for f in records.schema.fields if f.name != value]
        out = T.StructType([*kept, *fields.fields])
        names = [f.name for f in kept]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            read, target = reader(message), to_arrow_schema(out)
            for b in batches:
                at, rows = [], []
                for i, raw in enumerate(b.column(value).to_pylist()):
                    if raw is None:
                        continue
                    try:
                        row = read(raw)
                    except (ValueError, IndexError, KeyError, struct.error):
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

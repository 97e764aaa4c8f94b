"""Schemas of encoded rows: a StructType whose field metadata refines the encoding.

Metadata: {"decimal": [p, s]}, {"max_length": n, "truncate": b},
{"fixed_length": n, "truncate": b}.  Checked when an encoder is built."""

from __future__ import annotations

from pyspark.sql import types as T


def decimal(name: str, precision: int, scale: int, nullable: bool = True) -> T.StructField:
    return T.StructField(name, T.DecimalType(min(precision, 38), scale), nullable, {"decimal": [precision, scale]})


def max_length(name: str, n: int, truncate: bool = True, kind: T.DataType | None = None, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind or T.StringType(), nullable, {"max_length": n, "truncate": truncate})


def fixed_length(name: str, n: int, truncate: bool = True, kind: T.DataType | None = None, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind or T.StringType(), nullable, {"fixed_length": n, "truncate": truncate})


def check(field: T.StructField) -> None:
    meta = field.metadata or {}
    for key in ("max_length", "fixed_length"):
        if key in meta:
            if not isinstance(field.dataType, (T.StringType, T.BinaryType)):
                raise ValueError(f"{field.name}: {key} is for texts and bytes")
            if meta[key] < 1:
                raise ValueError(f"{field.name}: {key} must be at least 1")
    if "decimal" in meta:
        p, s = meta["decimal"]
        if not isinstance(field.dataType, T.DecimalType):
            raise ValueError(f"{field.name}: a decimal encoding is for decimals")
        if not (1 <= p <= 38 and 0 <= s <= p):
            raise ValueError(f"{field.name}: DECIMAL({p}, {s})")


def decimal_of(field: T.StructField) -> tuple[int, int]:
    meta = (field.metadata or {}).get("decimal")
    return tuple(meta) if meta else (field.dataType.precision, field.dataType.scale)

"""Binary encodings as columns: built-in expressions, Arrow batches for floats and wide decimals.

All functions return binary columns; a null input gives null unless stated."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

#: Microseconds and days from 1970 to 2000-01-01, the epoch of the native format.
NATIVE_EPOCH_US = 946_684_800_000_000
NATIVE_EPOCH_DAYS = 10_957


def reversed_bytes(raw: Column, size: int) -> Column:
    """Byte order turned round; the function reverse would turn characters."""
    return F.concat(*[F.substring(raw, i, 1) for i in range(size, 0, -1)])


def le_int(x: Column, size: int) -> Column:
    """Two's complement, little endian; higher bits are cut off."""
    digits = F.lpad(F.hex(x.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


@pandas_udf(BinaryType())
def le_float64(x: pd.Series) -> pd.Series:
    raw = x.to_numpy("<f8").tobytes()
    return pd.Series([None if null else raw[i * 8 : i * 8 + 8] for i, null in enumerate(x.isna())])


@pandas_udf(BinaryType())
def le_float32(x: pd.Series) -> pd.Series:
    raw = x.to_numpy("<f4").tobytes()
    return pd.Series([None if null else raw[i * 4 : i * 4 + 4] for i, null in enumerate(x.isna())])


def le_floats(x: Column, double: bool, nullable: bool) -> Column:
    """The elements of an array of floats one after another; a nullable one begins with 0, or is just 1 if null."""
    kind, size = ("<f8", 8) if double else ("<f4", 4)

    @pandas_udf(BinaryType())
    def run(arrays: pd.Series, nulls: pd.Series) -> pd.Series:
        out = []
        for a, missing in zip(arrays, nulls):  # nulls come as NaN, so they are told apart by a second array
            if a is None:
                out.append(None)
                continue
            raw = np.asarray(a, kind).tobytes()
            out.append(b"".join(b"\1" if m else b"\0" + raw[i * size : i * size + size] for i, m in enumerate(missing)) if nullable else raw)
        return pd.Series(out)

    return run(x, F.transform(x, lambda e: e.isNull()))


def scaled_int(d: Column, scale: int) -> Column:
    """The decimal times 10**scale, cut off toward zero, for results of up to 18 digits."""
    big = d * F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    return F.when(big >= 0, F.floor(big)).otherwise(F.ceil(big)).cast("bigint")


def decimal(d: Column, precision: int, scale: int) -> Column:
    """8 bytes up to 18 digits, then 16, with 38 digits 24; high group first, each little endian."""
    if not 0 <= scale <= precision <= 38:
        raise ValueError("decimals have a scale of at most their precision, and a precision of at most 38")
    if precision < 19:
        return le_int(scaled_int(d, scale), 8)

    # two halves by whole-number decimal arithmetic: floor(v / 2**64) and the rest
    unscaled = _digits(d, scale).cast("decimal(38,0)")
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    rest = F.pmod(unscaled, two64).cast("decimal(20,0)")
    high = ((unscaled - rest) / two64).cast("decimal(38,0)").cast("bigint")
    # a rest of 2**63 or more is a negative long
    low = F.when(rest >= F.lit("9223372036854775808").cast("decimal(20,0)"), rest - two64).otherwise(rest).cast("bigint")
    top = [le_int(F.when(high < 0, -1).otherwise(0), 8)] if precision == 38 else []  # a third group, which is the sign
    return F.when(d.isNotNull(), F.concat(*top, le_int(high, 8), le_int(low, 8)))


def _digits(d: Column, scale: int) -> Column:
    """The decimal's digits up to the scale without the point: its value times 10**scale, cut off toward zero."""
    text = d.cast("string")
    whole, part = F.substring_index(text, ".", 1), F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    return F.concat(whole, F.substring(F.rpad(part, max(scale, 1), "0"), 1, scale))


def leb128(n: Column) -> Column:
    """Unsigned varint of a length below 2**56; negative numbers raise."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x.cast("bigint")), 2, "0"))
    out = F.when(n < 0, F.raise_error(F.lit("a length cannot be negative")).cast("binary"))
    for k in range(1, 9):
        parts = [byte(F.shiftright(n, 7 * i).bitwiseAND(127) + (128 if i < k - 1 else 0)) for i in range(k)]
        out = out.when(n < 2 ** (7 * k), F.concat(*parts))
    return out


def utf8(s: Column) -> Column:
    return F.encode(s, "utf-8")


def _too_long(raw: Column, most: int) -> Column:
    return F.raise_error(F.concat(F.lit(f"longer than {most} bytes: "), F.octet_length(raw).cast("string"))).cast("binary")


def cut_bytes(raw: Column, most: int, truncate: bool = True) -> Column:
    return F.when(F.octet_length(raw) <= most, raw).otherwise(F.substring(raw, 1, most) if truncate else _too_long(raw, most))


def cut_utf8(s: Column, most: int, truncate: bool = True) -> Column:
    """At most so many bytes, cut between characters."""
    raw = utf8(s)
    if not truncate:
        return cut_bytes(raw, most, False)
    inside = lambda k: F.hex(F.substring(raw, k + 1, 1)).between("80", "BF")
    cut = F.lit(0)
    for k in range(max(0, most - 3), most + 1):
        cut = F.when(~inside(k), F.lit(k)).otherwise(cut)
    return F.when(F.octet_length(raw) <= most, raw).otherwise(F.substring(raw, F.lit(1), cut))


def pad(raw: Column, size: int, filler: bytes) -> Column:
    return F.rpad(raw, size, F.lit(filler))


def fixed_bytes(raw: Column, size: int, truncate: bool = True, filler: bytes = b"\0") -> Column:
    return pad(cut_bytes(raw, size, truncate), size, filler)


def fixed_utf8(s: Column, size: int, truncate: bool = True, filler: bytes = b" ") -> Column:
    return pad(cut_utf8(s, size, truncate), size, filler)


def uuid_bytes(u: Column) -> Column:
    return F.unhex(F.replace(u, F.lit("-"), F.lit("")))

"""The same encodings for single Python values: headers, wide decimals, tests."""

from __future__ import annotations

import decimal as _decimal
import struct

_decimal.getcontext().prec = max(_decimal.getcontext().prec, 1100)


def integer(x: int, size: int) -> bytes:
    return x.to_bytes(size, "little", signed=True)


def float32(x: float) -> bytes:
    return struct.pack("<f", x)


def float64(x: float) -> bytes:
    return struct.pack("<d", x)


def decimal(d, precision: int, scale: int) -> bytes:
    """Groups of 8 bytes, the highest first, each little endian; digits beyond the
    scale are cut off.  Raises if the number needs more bytes than the precision has."""
    size = (precision // 19 + 1) * 8
    whole = int(_decimal.Decimal(d).scaleb(scale))
    try:
        raw = whole.to_bytes(size, "big", signed=True)
    except OverflowError:
        raise ValueError(f"{d} does not fit DECIMAL({precision}, {scale})") from None
    return b"".join(raw[i : i + 8][::-1] for i in range(0, size, 8))


def leb128(n: int) -> bytes:
    if n < 0:
        raise ValueError("a length cannot be negative")
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def cut(raw: bytes, most: int, truncate: bool = True) -> bytes:
    if len(raw) > most and not truncate:
        raise ValueError(f"{len(raw)} bytes, at most {most}")
    return raw[:most]


def cut_utf8(s: str, most: int, truncate: bool = True) -> bytes:
    raw = s.encode()
    if len(raw) <= most:
        return raw
    if not truncate:
        raise ValueError(f"{len(raw)} bytes, at most {most}")
    return raw[:most].decode(errors="ignore").encode()


def fixed(raw: bytes, size: int, truncate: bool = True, filler: bytes = b"\0") -> bytes:
    return cut(raw, size, truncate).ljust(size, filler)


def fixed_utf8(s: str, size: int, truncate: bool = True, filler: bytes = b" ") -> bytes:
    return cut_utf8(s, size, truncate).ljust(size, filler)

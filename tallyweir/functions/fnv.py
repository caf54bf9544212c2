"""64-bit FNV-1 and FNV-1a hashes of column values, as expressions.

For parity with data that were keyed by these hashes elsewhere; sketches and sharding here use xxhash64, which spreads
short strings over all bits. The product by the prime 2**40 + 435 is made of two 32-bit halves, since ANSI arithmetic
does not wrap. Strings are hashed by their UTF-8 bytes, integers by their eight bytes, high byte first. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published algorithm.
OFFSET = 14695981039346656037
PRIME_LOW = 435
_MASK = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _hex(value: Column, kind: str) -> Column:
    """Two hexadecimal digits a byte."""
    return F.lpad(F.hex(value.cast("bigint")), 16, "0") if kind in ("tinyint", "smallint", "int", "bigint") else F.hex(value)


def _times_prime(hi: Column, lo: Column) -> tuple[Column, Column]:
    low = lo * PRIME_LOW
    high = hi * PRIME_LOW + F.shiftright(low, 32) + F.shiftleft(lo, 8)
    return high.bitwiseAND(_long(_MASK)), low.bitwiseAND(_long(_MASK))


def _fnv(value: Column, kind: str, xor_first: bool, start: Column | None) -> Column:
    digits = _hex(value, kind)
    n = F.length(digits)
    starts = F.when(n > 0, F.sequence(F.lit(1), n - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(state: Column, at: Column) -> Column:
        byte = F.conv(F.substr(digits, at, F.lit(2)), 16, 10).cast("bigint")
        hi, lo = state["hi"], state["lo"]
        if xor_first:
            hi, lo = _times_prime(hi, lo.bitwiseXOR(byte))
        else:
            hi, lo = _times_prime(hi, lo)
            lo = lo.bitwiseXOR(byte)
        return F.struct(hi.alias("hi"), lo.alias("lo"))

    if start is None:
        begin = F.struct(_long(OFFSET >> 32).alias("hi"), _long(OFFSET & _MASK).alias("lo"))
    else:
        begin = F.struct(F.shiftrightunsigned(start, 32).alias("hi"), start.bitwiseAND(_long(_MASK)).alias("lo"))
    hash = F.aggregate(starts, begin, step, lambda s: F.shiftleft(s["hi"], 32).bitwiseOR(s["lo"]))
    return F.when(value.isNotNull() if start is None else value.isNotNull() & start.isNotNull(), hash)


def fnv1(value: Column, kind: str = "string", start: Column | None = None) -> Column:
    """FNV-1 as a signed BIGINT with the hash's 64 bits. ``kind`` is the column's type name. ``start``: the hash of what
    comes before, which is then continued."""
    return _fnv(value, kind, False, start)


def fnv1a(value: Column, kind: str = "string", start: Column | None = None) -> Column:
    """FNV-1a, likewise."""
    return _fnv(value, kind, True, start)


class Fnv:
    """The same on the driver, piece by piece. ``value`` is unsigned."""

    def __init__(self, xor_first: bool = False) -> None:
        self.xor_first = xor_first
        self.reset()

    def reset(self) -> None:
        self.value = OFFSET

    def update(self, data: bytes | str | int) -> Fnv:
        """Bytes, a text by its UTF-8 bytes, or an integer by its eight bytes, high byte first."""
        if isinstance(data, int):
            data = (data & (1 << 64) - 1).to_bytes(8, "big")
        prime, mask = (1 << 40) + PRIME_LOW, (1 << 64) - 1
        for byte in data.encode() if isinstance(data, str) else data:
            self.value = ((self.value ^ byte) * prime if self.xor_first else (self.value * prime) ^ byte) & mask
        return self


def fnv_bytes(data: bytes, xor_first: bool = False) -> int:
    return Fnv(xor_first).update(data).value

"""Packed arrays of small counters: n counters of 1 to 8 bits, most significant bit first, saturating.

``pack`` and ``unpack`` are the stored form (a version byte, the width, n in eight bytes low first, then the bits); as a
relation counters are rows (bucket, value), see ``operators.counters``.
"""

from __future__ import annotations

import numpy as np

VERSION = 1


def pack(values: np.ndarray, width: int) -> bytes:
    """Counters to bytes; values above the maximum of the width are stored as the maximum."""
    if not 1 <= width <= 8:
        raise ValueError("the width is 1 to 8 bits")
    values = np.minimum(np.asarray(values, np.int64), (1 << width) - 1).astype(np.uint8)
    if (np.asarray(values) < 0).any():
        raise ValueError("counters are not negative")
    bits = np.unpackbits(values[:, None], axis=1)[:, 8 - width :]
    return bytes([VERSION, width]) + len(values).to_bytes(8, "little") + np.packbits(bits.ravel()).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The counters of ``pack``; other versions and missing or spare bytes are errors."""
    if len(data) < 10 or data[0] != VERSION:
        raise ValueError("not a bucket array of this version")
    width, n = data[1], int.from_bytes(data[2:10], "little")
    if not 1 <= width <= 8 or len(data) != size(n, width):
        raise ValueError("a bucket array of the wrong length")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=10), count=n * width).reshape(n, width)
    return (bits.astype(np.int64) << np.arange(width)[::-1]).sum(1)


def size(n: int, width: int) -> int:
    """Bytes of ``pack``."""
    return 10 + (n * width + 7) // 8


def add(values: np.ndarray, bucket: int, by: int, width: int) -> None:
    """Raises one counter, up to the maximum."""
    values[bucket] = min(int(values[bucket]) + by, (1 << width) - 1)


def count_of(values: np.ndarray, value: int) -> int:
    """How many counters have the value."""
    return int((values == value).sum())

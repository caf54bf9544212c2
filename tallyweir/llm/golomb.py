"""Golomb-coded sets of 64-bit hashes, on numpy arrays.

A set keeps the top ``width`` bits of each hash, sorted. Of each block of ``BLOCK`` values the first is kept as it is;
the others are gaps to the value before, in Golomb-Rice code: the gap's quotient by 2**rice in unary, the remainder in
``rice`` bits. A probe finds the block by the first values and decodes only the blocks that some probe falls into.
Hashes in the set are always found; another hash is found with probability len(set) / 2**width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64
_U = np.uint64


@dataclass(frozen=True)
class GolombSet:
    width: int
    rice: int
    n: int
    firsts: np.ndarray  # uint64, the first value of each block
    starts: np.ndarray  # int64, the bit at which the block's gaps begin
    bits: np.ndarray  # uint8, packed; 16 spare bytes at the end

    @property
    def size(self) -> int:
        """Bytes held."""
        return self.firsts.nbytes + self.starts.nbytes + self.bits.nbytes

    @property
    def false_rate(self) -> float:
        return self.n / 2.0**self.width

    def to_bytes(self) -> bytes:
        head = np.array([self.width, self.rice, self.n, len(self.firsts)], np.int64)
        return head.tobytes() + self.firsts.tobytes() + self.starts.tobytes() + self.bits.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> GolombSet:
        width, rice, n, blocks = np.frombuffer(data, np.int64, 4).tolist()
        at = 32
        firsts = np.frombuffer(data, _U, blocks, at)
        starts = np.frombuffer(data, np.int64, blocks, at + 8 * blocks)
        return GolombSet(width, rice, n, firsts, starts, np.frombuffer(data, np.uint8, offset=at + 16 * blocks))


def reduced(hashes: np.ndarray, width: int) -> np.ndarray:
    """The top ``width`` bits of 64-bit hashes."""
    return hashes.view(_U) >> _U(64 - width)


def encode(values: np.ndarray, width: int) -> GolombSet:
    """The set of reduced hashes (uint64, in any order, with repeats)."""
    values = np.unique(values)
    n = len(values)
    if n == 0:
        return GolombSet(width, 0, 0, values, np.zeros(0, np.int64), np.zeros(16, np.uint8))
    rice = max(0, int(np.floor(np.log2(max(1.0, 2.0**width / n * np.log(2))))))
    gaps = np.diff(values, prepend=values[:1])
    first = np.arange(n) % BLOCK == 0
    quotient = (gaps >> _U(rice)).astype(np.int64)
    length = np.where(first, 0, quotient + 1 + rice)
    ends = np.cumsum(length)
    begins = ends - length
    coded = ~first
    gap, q, begin = gaps[coded], quotient[coded], begins[coded]
    bits = np.zeros(int(ends[-1]), np.uint8)
    if len(q):
        ones = np.repeat(begin - np.concatenate(([0], np.cumsum(q)[:-1])), q) + np.arange(int(q.sum()))
        bits[ones] = 1
        at = begin + q + 1
        for j in range(rice):
            bits[at + j] = (gap >> _U(rice - 1 - j)) & _U(1)
    packed = np.concatenate((np.packbits(bits), np.zeros(16, np.uint8)))
    return GolombSet(width, rice, n, values[first], begins[first], packed)


def _peek(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bits from ``at`` on, left-aligned in 64 (at least 57 of them)."""
    byte = at >> 3
    word = np.zeros(len(at), _U)
    for j in range(8):
        word = (word << _U(8)) | bits[byte + j].astype(_U)
    return word << (at & 7).astype(_U)


def decode(coded: GolombSet, blocks: np.ndarray) -> np.ndarray:
    """The values of the given blocks (ascending numbers), in order."""
    size = np.minimum(BLOCK, coded.n - blocks * BLOCK)
    out = np.zeros((len(blocks), BLOCK), _U)
    value = coded.firsts[blocks]
    out[:, 0] = value
    at = coded.starts[blocks].copy()
    live = np.flatnonzero(size > 1)
    value, at = value[live], at[live]
    for i in range(1, BLOCK):
        on = size[live] > i
        if not on.all():
            live, value, at = live[on], value[on], at[on]
        if not len(live):
            break
        quotient = np.zeros(len(live), np.int64)
        more = np.arange(len(live))
        while len(more):  # 48 bits of the unary part at a time
            zeros = ~_peek(coded.bits, at[more]) >> _U(16)
            run = 48 - np.frexp(zeros.astype(np.float64))[1]
            quotient[more] += run
            at[more] += run
            more = more[run == 48]
        at += 1
        rest = _peek(coded.bits, at) >> _U(64 - coded.rice) if coded.rice else np.zeros(len(live), _U)
        at += coded.rice
        value = value + (quotient.astype(_U) << _U(coded.rice)) + rest
        out[live, i] = value
    return out[np.arange(BLOCK) < size[:, None]]


def contains(coded: GolombSet, values: np.ndarray) -> np.ndarray:
    """For each reduced hash, whether it is in the set."""
    if coded.n == 0 or len(values) == 0:
        return np.zeros(len(values), bool)
    block = np.searchsorted(coded.firsts, values, side="right") - 1
    probed = np.unique(block[block >= 0])
    if not len(probed):
        return np.zeros(len(values), bool)
    there = decode(coded, probed)
    place = np.minimum(np.searchsorted(there, values), len(there) - 1)
    return there[place] == values


def union(parts: list[GolombSet]) -> GolombSet:
    """The set of all values of sets of one width."""
    values = [decode(p, np.arange(len(p.firsts))) for p in parts if p.n]
    return encode(np.concatenate(values) if values else np.zeros(0, _U), parts[0].width)

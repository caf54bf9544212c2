"""Mergeable quantile sketches by randomized compactor hierarchies, on numpy arrays.

A sketch is a list of levels; a value at level h stands for 2**h values of the input. New values enter level 0. When the
sketch is over its size, the lowest level that is over its own share is *compacted*: it is sorted and every other value,
from a random start of two, moves to the next level. Levels below the top have shares that fall by 2/3 a level. Two
sketches merge level by level.

A compaction of level h moves any rank by 2**h up, 2**h down or not at all, with mean 0 and independently of others. So
the error of a rank is sub-Gaussian with variance proxy sum(4**h) over all compactions that happened, which the sketch
carries (``spread``) and merging adds up. With probability 1 - delta an estimated rank is off by at most
sqrt(2 ln(2 / delta) spread), whatever the data and the order of merges; no compaction, no error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

K = 400
DELTA = 1e-6
SHRINK = 2 / 3
LEAST = 8


def shares(k: int, levels: int) -> list[int]:
    """The size of each level, lowest first."""
    return [max(LEAST, math.ceil(k * SHRINK ** (levels - 1 - h))) for h in range(levels)]


@dataclass
class Sketch:
    k: int = K
    n: int = 0
    spread: float = 0.0
    low: float = math.inf
    high: float = -math.inf
    levels: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)])

    def add(self, values: np.ndarray, rng: np.random.Generator) -> None:
        """Adds numbers without NaN."""
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate((self.levels[0], values)) if len(self.levels[0]) else values
            self._shrink(rng)

    def merge(self, others: list[Sketch], rng: np.random.Generator) -> None:
        parts = [self, *others]
        self.levels = [
            np.concatenate([p.levels[h] for p in parts if h < len(p.levels)]) for h in range(max(len(p.levels) for p in parts))
        ]
        self.n = sum(p.n for p in parts)
        self.spread = sum(p.spread for p in parts)
        self.low, self.high = min(p.low for p in parts), max(p.high for p in parts)
        self._shrink(rng)

    def _shrink(self, rng: np.random.Generator) -> None:
        while True:
            room = shares(self.k, len(self.levels))
            if sum(map(len, self.levels)) <= sum(room):
                return
            h = next(h for h, level in enumerate(self.levels) if len(level) > room[h])
            level = np.sort(self.levels[h])
            even = len(level) & ~1
            rest = level[even:]  # one value of an odd number stays
            if h + 1 == len(self.levels):
                self.levels.append(np.zeros(0))
            start = int(rng.integers(2))
            self.levels[h + 1] = np.concatenate((self.levels[h + 1], level[start:even:2]))
            self.levels[h] = rest
            self.spread += 4.0**h

    def rank_error(self, delta: float = DELTA) -> float:
        """The bound on the error of a rank, as a share of n."""
        return min(1.0, math.sqrt(2 * math.log(2 / delta) * self.spread) / self.n) if self.n else 0.0

    def quantiles(self, permille: np.ndarray) -> np.ndarray:
        """For each p the smallest kept value whose estimated rank is at least ceil(n p / 1000), the true least and
        greatest value at the ends."""
        values = np.concatenate(self.levels)
        weights = np.repeat([2**h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        wanted = np.maximum(1, (self.n * permille + 999) // 1000)
        out = values[order][np.minimum(np.searchsorted(upto, wanted), len(values) - 1)]
        return np.where(permille <= 0, self.low, np.where(permille >= 1000, self.high, out))

    def to_bytes(self) -> bytes:
        head = np.array([self.k, self.n, len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + np.array([self.spread, self.low, self.high]).tobytes() + np.concatenate(self.levels).tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Sketch:
        k, n, count = np.frombuffer(data, np.int64, 3).tolist()
        sizes = np.frombuffer(data, np.int64, count, 24)
        at = 24 + 8 * count
        spread, low, high = np.frombuffer(data, np.float64, 3, at).tolist()
        values = np.frombuffer(data, np.float64, offset=at + 24)
        return Sketch(k, n, spread, low, high, np.split(values, np.cumsum(sizes)[:-1]))

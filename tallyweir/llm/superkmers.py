"""Windows of text, their minimisers and super-k-mers, on numpy arrays of code points.

A window is ``SPAN`` characters. Its minimiser is the least hash among its pieces of ``PIECE`` characters, so equal
windows have equal minimisers wherever they stand. Neighbouring windows mostly share theirs: a *super-k-mer* is the
stretch of text under a run of windows with one minimiser, and takes the place of all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPAN = 80
PIECE = 32
#: Texts are cut into stretches of this many characters (with SPAN - 1 more), super-k-mers into this many windows.
STRETCH, LONGEST = 1 << 19, 2048

_U = np.uint64
_SEEDS = ((0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x ^= x >> _U(31)
    x *= _U(by)
    x ^= x >> _U(29)
    return x


def _joined(left: np.ndarray, right: np.ndarray, seed: tuple[int, int, int], step: int) -> np.ndarray:
    return _mixed(left * _U(seed[0]) + (right ^ _U(seed[2] * step & (1 << 64) - 1)), seed[1])


def hashes(points: np.ndarray, lengths: tuple[int, ...], seed: int = 0) -> list[np.ndarray]:
    """For each length the hash of the characters from each position on (as far as they go), by doubling."""
    s = _SEEDS[seed]
    levels = {1: _mixed(points.astype(_U) + _U(s[2]), s[0])}
    size = 1
    while size * 2 <= max(lengths):
        h = levels[size]
        levels[size * 2] = _joined(h[: max(0, len(h) - size)], h[size:], s, size)
        size *= 2
    out = []
    for length in lengths:
        at, h = 0, None
        for size in sorted(levels, reverse=True):
            if length - at >= size:
                part = levels[size]
                if h is None:
                    h = part
                else:
                    n = max(0, min(len(h), len(part) - at))
                    h = _joined(h[:n], part[at : at + n], s, size + 1)
                at += size
        out.append(h)
    return out


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Text:
    """Texts one after the other, as code points."""

    points: np.ndarray
    begins: np.ndarray  # where each text begins, and the end

    @staticmethod
    def of(texts: list[str]) -> Text:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return Text(points, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))))

    def windows(self) -> np.ndarray:
        """The positions at which a whole window of one text begins."""
        whole = np.zeros(len(self.points) + 1, np.int32)
        long = np.diff(self.begins) >= SPAN
        np.add.at(whole, self.begins[:-1][long], 1)
        np.add.at(whole, self.begins[1:][long] - SPAN + 1, -1)
        return np.flatnonzero(np.cumsum(whole[:-1]))

    def text_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, positions, side="right") - 1


@dataclass
class SuperKmers:
    minimiser: np.ndarray  # int64
    print: np.ndarray  # int64, a fingerprint of the characters
    text: np.ndarray  # the number of the text
    begin: np.ndarray  # in the text
    n_windows: np.ndarray


def super_kmers(text: Text, prints: bool = True) -> SuperKmers:
    at = text.windows()
    if not len(at):
        none = np.zeros(0, np.int64)
        return SuperKmers(none, none, none, none, none)
    piece, window = hashes(text.points, (PIECE, SPAN))
    least = _sliding_least(piece, SPAN - PIECE + 1)[at]
    owner = text.text_at(at)
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(owner) != 0) | (least[1:] != least[:-1])))
    first = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.concatenate((first, [len(at)]))))
    first = np.flatnonzero(nth % LONGEST == 0)
    size = np.diff(np.concatenate((first, [len(at)])))
    if prints:
        place = (nth % LONGEST).astype(_U) * _U(_SEEDS[1][0])
        fingerprint = np.add.reduceat(_mixed(window[at] + place, _SEEDS[1][1]), first).view(np.int64)
    else:
        fingerprint = np.zeros(len(first), np.int64)
    return SuperKmers(least[first].view(np.int64), fingerprint, owner[first], at[first] - text.begins[owner[first]], size)


def shared_windows(text: Text, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the texts and whether each occurs in two records: ``low`` and ``high`` are the least and greatest
    record in which a text occurs. Windows are sorted by hash, and those of one hash compared character by character."""
    at = text.windows()
    if not len(at):
        return at, np.zeros(0, bool)
    (window,) = hashes(text.points, (SPAN,))
    keys, owner = window[at], text.text_at(at)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((first, [len(keys)])))
    least, greatest = np.minimum.reduceat(low[owner[order]], first), np.maximum.reduceat(high[owner[order]], first)
    shared = np.repeat(least < greatest, size)
    check = np.flatnonzero(shared & (np.repeat(size, size) > 1))
    model = np.repeat(first, size)
    for i in range(0, len(check), 20_000):
        some = check[i : i + 20_000]
        a, b = at[order[some]], at[order[model[some]]]
        same = np.ones(len(some), bool)
        for j in range(SPAN):
            same &= text.points[a + j] == text.points[b + j]
        for odd in np.unique(model[some[~same]]):  # different windows of one hash
            _by_characters(text, at, order, owner, low, high, shared, odd, odd + size[np.searchsorted(first, odd)])
    flags = np.zeros(len(at), bool)
    flags[order] = shared
    return at, flags


def _by_characters(text: Text, at, order, owner, low, high, shared, begin: int, end: int) -> None:
    seen: dict[bytes, list[int]] = {}
    for i in range(begin, end):
        p = at[order[i]]
        seen.setdefault(text.points[p : p + SPAN].tobytes(), []).append(i)
    for places in seen.values():
        owners = owner[order[places]]
        shared[places] = low[owners].min() < high[owners].max()


def stretches(texts: list[str]) -> tuple[list[str], list[int], list[int]]:
    """Long texts cut into stretches that overlap by SPAN - 1: the stretches, their texts' numbers and beginnings."""
    parts, owner, begin = [], [], []
    for i, t in enumerate(texts):
        for b in range(0, max(1, len(t) - SPAN + 1), STRETCH):
            parts.append(t[b : b + STRETCH + SPAN - 1] if len(t) > STRETCH + SPAN - 1 else t)
            owner.append(i)
            begin.append(b)
    return parts, owner, begin

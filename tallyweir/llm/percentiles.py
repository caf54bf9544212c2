"""Percentiles per group from mergeable sketches, combined over portions such as days.

Each task that reads the table turns its rows into one sketch per group and portion before anything is shuffled, so a
group that holds a third of all rows sends no more than a small one. Sketches are shuffled by (group, portion), merged
in the order of that key while they stream through the task (a handful in memory at a time, however many there are),
and again by group. ``portions`` gives the sketches of the portions as a table: those of separate days, written at
different times, are united and given to ``combine``.

Null and NaN are no numbers; a group or portion without numbers has no row. A null group or portion is one of its own.
Ties are ordinary values. Repeated rows count each time. An empty table gives empty results. The random choices are
seeded by group, portion, partition and chunk: tasks choose independently of each other, as the error bound needs, and a
task that runs again gives the same sketch for the same input order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.compactors import DELTA, K, Sketch

#: Rows that a task gathers before it sketches them; sketches of one key that are merged at once.
CHUNK = 1 << 20
FAN_IN = 32

_STATE = "group string, portion string, sketch binary"
_RESULT = "group string, portion string, n bigint, permille int, value double, rank_error double"


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(key).encode()))


def _groups(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """The runs of equal numbers, as (begin, end)."""
    cuts = np.flatnonzero(np.diff(codes)) + 1
    yield from zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(codes)])).tolist())


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _sketch_chunk(chunk: list[pa.RecordBatch], k: int, *seed: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(chunk)
    (a, groups), (b, portions) = _codes(table.column(0)), _codes(table.column(1))
    values = table.column(2).to_numpy()
    codes = a * len(portions) + b
    order = np.lexsort((values, codes))
    codes, values = codes[order], values[order]
    out: tuple[list, list, list] = ([], [], [])
    for begin, end in _groups(codes):
        group, portion = groups[int(codes[begin]) // len(portions)], portions[int(codes[begin]) % len(portions)]
        sketch = Sketch(k)
        sketch.add(values[begin:end], _rng(group, portion, *seed))
        for column, x in zip(out, (group, portion, sketch.to_bytes())):
            column.append(x)
    return pa.record_batch([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["group", "portion", "sketch"])


def _partial(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, number = [], 0, 0
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        for batch in batches:
            chunk.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield _sketch_chunk(chunk, k, task, number)
                chunk, rows, number = [], 0, number + 1
        if rows:
            yield _sketch_chunk(chunk, k, task, number)

    return run


class _Merging:
    """The sketch of the key at hand, from sketches that come one by one."""

    def __init__(self) -> None:
        self.parts: list[Sketch] = []
        self.rng: np.random.Generator | None = None

    def take(self, sketch: Sketch, key: tuple) -> None:
        if not self.parts:
            self.rng = _rng(*key)
        self.parts.append(sketch)
        if len(self.parts) >= FAN_IN:
            self.parts = [self.done()]

    def done(self) -> Sketch:
        first, *others = self.parts
        if others:
            first.merge(others, self.rng)
        return first


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None, bytes]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _merge_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches in the order of their keys, to one sketch a key."""
    key, at, out = None, _Merging(), []

    def batch() -> pa.RecordBatch:
        columns = zip(*out)
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()))], names=["group", "portion", "sketch"])

    for group, portion, data in _rows(batches):
        if at.parts and key != (group, portion):
            out.append((*key, at.done().to_bytes()))
            at = _Merging()
            if len(out) >= 1000:
                yield batch()
                out = []
        key = (group, portion)
        at.take(Sketch.from_bytes(data), key)
    if at.parts:
        out.append((*key, at.done().to_bytes()))
        yield batch()


def _answers(permille: Sequence[int], delta: float, each_portion: bool):
    wanted = np.array(permille, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def say(group: str | None, portion: str | None, sketch: Sketch) -> None:
            error = sketch.rank_error(delta)
            out.extend((group, portion, sketch.n, p, v, error) for p, v in zip(permille, sketch.quantiles(wanted).tolist()))

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
            names = ["group", "portion", "n", "permille", "value", "rank_error"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        key, at = None, _Merging()
        for group, portion, data in _rows(batches):
            if at.parts and key != group:
                say(key, ALL, at.done())
                at = _Merging()
            key = group
            sketch = Sketch.from_bytes(data)
            if each_portion:
                say(group, portion, sketch)
            at.take(sketch, (group,))
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if at.parts:
            say(key, ALL, at.done())
        if out:
            yield batch()

    return run


#: The portion of the rows that combine all portions of a group.
ALL = "all"


def portions(df: DataFrame, group: Column, portion: Column, value: Column, k: int = K) -> DataFrame:
    """(group, portion, sketch): a mergeable sketch of the numbers of each group and portion (both as strings)."""
    slim = df.select(group.cast("string").alias("group"), portion.cast("string").alias("portion"), (value.cast("double") + F.lit(0.0)).alias("value"))
    partial = slim.where("value is not null and not isnan(value)").mapInArrow(_partial(k), _STATE)
    return merge_portions(partial)


def merge_portions(sketches: DataFrame) -> DataFrame:
    """Sketches of portions that may occur several times, to one a portion."""
    return sketches.select("group", "portion", "sketch").repartition("group", "portion").sortWithinPartitions("group", "portion").mapInArrow(_merge_portions, _STATE)


def combine(sketches: DataFrame, permille: Sequence[int], delta: float = DELTA, each_portion: bool = False) -> DataFrame:
    """group, portion, n, permille, value, rank_error: the percentiles of each group over all its portions (portion
    'all') and, if ``each_portion``, of each portion. With probability 1 - delta, the rank of ``value`` is within
    ``rank_error`` * n of the one asked for."""
    by_group = sketches.select("group", "portion", "sketch").repartition("group").sortWithinPartitions("group", "portion")
    return by_group.mapInArrow(_answers(permille, delta, each_portion), _RESULT)

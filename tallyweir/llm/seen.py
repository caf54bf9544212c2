"""Has this key been seen before? Golomb-coded sets, one per hash shard.

A key is its 64-bit hash from the scan on; no key string is shuffled, joined or kept. Each task reduces the log to the
distinct hashes of ``CHUNK`` rows at a time and sends them on packed by shard, so a key that fills a third of the log
costs eight bytes a chunk. A shard (about ``SHARD_KEYS`` keys, by the hash modulo their number) becomes one Golomb-coded
set of the top bits of its hashes: about 4 bytes a key, whatever the key's length. The sets are a table (slot, shard, n,
coded) that may be written and used again (``llm.history`` does so).

Incoming rows are taken in their order in ``epochs`` portions. Inside a portion the first row of each key is found among
the portion's own hashes, packed and reduced in the same way; only those first rows probe, first the log's set of their
shard and then the sets of the earlier portions of the stream, to which the portion's new keys are added afterwards. The
sets of the portions are merged like the runs of a log-structured tree, so there are few to probe. What is held of the
earlier keys are the sets alone, of one shard a task.

"Not seen" is always right. "Seen" is wrong with probability n / 2**width for each set that is probed (and n / 2**64
inside a portion), at most one in ``ONE_IN`` for a full set; a key that is once taken for a seen one stays so. ``audit`` tells
how often it happened: it decides exactly, for all keys or for those of a hash sample.

Null and empty keys are no keys: such rows are no cases. Rows are told apart by the id column, which must be unique;
rows without id are no cases. Repeated rows are seen rows. An empty log or an empty stream is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm import golomb

SHARD_KEYS = 1 << 18
#: The theoretical rate of false positives of a set is at most one in this at twice SHARD_KEYS keys in a shard.
ONE_IN = 1 << 26
EPOCHS = 8
#: Rows that a task reduces at a time.
CHUNK = 1 << 20
#: Sets are stored in at most so many folders and files.
SLOTS = 64
#: Share of the keys that an audit decides exactly, in 256ths: that of a sampled one, and that of a whole one.
SAMPLE, ALL = 64, 256

SETS = "slot bigint, shard bigint, n bigint, coded binary"
_PROBED = "id bigint, seen boolean, false_rate double"


def width_for(one_in: int, keys: int = 2 * SHARD_KEYS) -> int:
    """Bits of a hash to keep for a rate of false positives of at most one in ``one_in`` with so many keys a shard."""
    return min(64, max(1, (max(1, keys) * one_in - 1).bit_length()))


WIDTH = width_for(ONE_IN)


def first_value(data: Column, field: str) -> Column:
    """The value of the first element of an array of (f, v) with that field; null if there is none or it is empty."""
    value = F.try_element_at(F.filter(data, lambda x: x["f"] == field), F.lit(1))["v"]
    return F.when(value != "", value)


def hashes(df: DataFrame, key: Column, *others: Column) -> DataFrame:
    """The hashes of the keys (repeats included), with other columns."""
    return df.select(key.alias("key"), *others).where("key is not null and key != ''").select(F.xxhash64("key").alias("hash"), *(c for c in df.select(*others).columns))


def shards_for(n_keys: int) -> int:
    return max(1, ceil(n_keys / SHARD_KEYS))


def firsts(columns: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Of rows (hash, epoch, id) the one with the least id of each hash and epoch; of (hash, id) likewise; of (hash) the
    distinct ones."""
    order = np.lexsort(tuple(columns[::-1]) if len(columns) < 3 else (columns[2], columns[1], columns[0]))
    sorted_ = [c[order] for c in columns]
    same = np.ones(len(order), bool)
    for c in sorted_[: max(1, len(columns) - 1)]:
        same[1:] &= c[1:] == c[:-1]
    same[:1] = False
    return [c[~same] for c in sorted_]


def packed(df: DataFrame, shards: int) -> DataFrame:
    """slot, shard and the columns of ``df`` (bigints, the hash first) packed to bytes, a row for each chunk and shard,
    reduced to the first rows of the chunk."""
    names = df.columns
    slots = min(shards, SLOTS)

    def pack(chunk: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(chunk)
        columns = firsts([c.to_numpy() for c in table.columns])
        shard = columns[0] % shards
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        starts = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = pa.py_buffer((np.append(starts, len(shard)) * 8).astype(np.int32))
        there = shard[starts]
        bytes_ = [pa.Array.from_buffers(pa.binary(), len(there), [None, ends, pa.py_buffer(np.ascontiguousarray(c[order]))]) for c in columns]
        return pa.record_batch([pa.array(there * slots // shards), pa.array(there), *bytes_], names=["slot", "shard", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows = [], 0
        for batch in batches:
            chunk.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield pack(chunk)
                chunk, rows = [], 0
        if rows:
            yield pack(chunk)

    return df.mapInArrow(run, "slot bigint, shard bigint, " + ", ".join(f"{n} binary" for n in names))


def unpacked(table: pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    """The rows of a shard from all its chunks, reduced to the first ones."""
    return firsts([np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in table.column(n)] or [np.zeros(0, np.int64)]) for n in names])


def build(keys: DataFrame, shards: int, width: int = WIDTH, by_slot: bool = False) -> DataFrame:
    """(slot, shard, n, coded) of a table of hashes, repeats allowed. ``by_slot``: a slot's sets come from one task, for
    tables that are stored by slot."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        coded = golomb.encode(golomb.reduced(unpacked(group, ["hash"])[0], width), width)
        return pa.table({"slot": [key[0].as_py()], "shard": [key[1].as_py()], "n": [coded.n], "coded": [coded.to_bytes()]})

    rows = packed(keys.select("hash"), shards)
    rows = rows.repartition("slot") if by_slot else rows.repartition("shard")
    return rows.groupBy("slot", "shard").applyInArrow(run, SETS)


def _probe(width: int):
    def run(key: tuple, group: pa.Table, sets: pa.Table) -> pa.Table:
        """The first rows of one shard, portion by portion, against the log's set and those of earlier portions."""
        hash, epochs, ids = unpacked(group, ["hash", "epoch", "id"])
        values = golomb.reduced(hash, width)
        seen, rate = np.zeros(len(values), bool), np.zeros(len(values))
        for coded in (golomb.GolombSet.from_bytes(b.as_buffer().to_pybytes()) for b in sets.column("coded")):
            seen |= golomb.contains(coded, values)
            rate += coded.false_rate
        runs: list[tuple[int, golomb.GolombSet]] = []  # (level, set): each level about twice the one after it
        for epoch in np.unique(epochs):
            rows = np.flatnonzero(epochs == epoch)
            for _, coded in runs:
                seen[rows] |= golomb.contains(coded, values[rows])
                rate[rows] += coded.false_rate
            runs.append((0, golomb.encode(values[rows][~seen[rows]], width)))
            while len(runs) > 1 and runs[-1][0] == runs[-2][0]:
                level, last = runs.pop()
                runs[-1] = (level + 1, golomb.union([runs[-1][1], last]))
        return pa.table({"id": ids, "seen": seen, "false_rate": np.minimum(rate, 1.0)})

    return run


def _epoch(df: DataFrame, epochs: int, bounds: tuple[int | None, int | None] | None) -> Column:
    low, high = bounds or df.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return F.lit(0).cast("bigint")
    width = max(1, ceil((high - low + 1) / epochs))
    return F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("bigint")


def probe(stream: DataFrame, sets: DataFrame, shards: int, epochs: int = EPOCHS, width: int = WIDTH, bounds: tuple[int | None, int | None] | None = None) -> DataFrame:
    """id, seen and false_rate (in theory, for this probe) of the first row of each key and portion, as the sets say.

    ``stream``: id and hash of the rows with a key. ``bounds``: the least and greatest id, if they are known; portions are
    equal stretches between them.
    """
    placed = stream.where("id is not null").select("hash", _epoch(stream, epochs, bounds).alias("epoch"), "id")
    return packed(placed, shards).groupBy("shard").cogroup(sets.groupBy("shard")).applyInArrow(_probe(width), _PROBED)


def seen(stream: DataFrame, probed: DataFrame) -> DataFrame:
    """The ids of the rows of ``stream`` whose key occurred before: all but the first rows that the sets do not know.
    Each id is there once, so taking those away is a join without heavy keys."""
    return stream.where("id is not null").select("id").join(probed.where("not seen").select("id"), "id", "left_anti")


def sampled(key: Column, sample: int = SAMPLE) -> Column:
    """Whether an audit takes the key: by the first byte of its md5, which the sets do not use. A whole audit takes all."""
    return F.substring(F.md5(key), 1, 2) < F.lit(f"{sample:02x}") if sample < ALL else F.lit(True)


def audit(rows: DataFrame, log: DataFrame, probed: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row on the keys of the sample, or on all keys if that is ``ALL``: ``audited`` (keys of the rows that had not
    occurred), ``false_positives`` (those of them that the sets took for seen), ``missed`` (rows taken for new that were
    not), the number of false positives ``expected`` in theory, both rates (null if nothing was audited), and
    ``within_limits``: whether what was found is within five standard deviations, and one, of what was expected, and
    nothing was missed.

    ``rows``: id and key of the incoming rows; ``log``: key. Rows and log are cut to the sample before they are joined. The
    first rows of the new keys are found without the answers, so that audits of several sets of a query share them.
    """
    mine = rows.where("id is not null and key is not null and key != ''").where(sampled(F.col("key"), sample))
    known = log.select("key").where("key is not null and key != ''").where(sampled(F.col("key"), sample)).distinct()
    new = mine.groupBy("key").agg(F.min("id").alias("id")).join(known, "key", "left_anti").select("id", F.lit(True).alias("new"))
    answers = probed if sample >= ALL else probed.join(mine.select("id"), "id", "left_semi")
    is_new, said_seen = F.col("new").isNotNull(), F.coalesce("seen", F.lit(True))  # without an answer a row is a seen one
    sums = new.join(answers, "id", "full").agg(
        F.count_if(is_new).alias("audited"),
        F.count_if(is_new & said_seen).alias("false_positives"),
        F.count_if(~is_new & ~said_seen).alias("missed"),
        F.coalesce(F.sum(F.when(is_new, F.col("false_rate"))), F.lit(0.0)).alias("expected"),
    )
    near = F.abs(F.col("false_positives") - F.col("expected")) <= 1 + 5 * F.sqrt("expected")
    return sums.withColumns(
        {
            "theoretical_rate": F.try_divide("expected", "audited"),
            "audited_rate": F.try_divide("false_positives", "audited"),
            "within_limits": near & (F.col("missed") == 0),
        }
    )

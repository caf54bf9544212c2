"""Seen keys of a stream, batch after batch, without keeping the keys.

Each batch probes the Golomb-coded sets of the log and of all batches before it and then adds a set of its own new keys
(one row a shard), written under the batch's number, so a batch that runs again sees the same history and counts once.
Compaction unites the sets of a shard without their keys. What is kept is about 4 bytes a key.

The sets lie in folders by *slot*, a range of shards. A batch reads the slots that its keys fall into and nothing else,
and the sets are not shuffled: the batch's hashes, packed by shard, go to the tasks that read the sets (as a broadcast
where they are at most ``CARRIED`` bytes, by a shuffle beyond), each set decodes the blocks that are probed, and only the
answers, a bit a hash, come back. The new keys are found once and written; the batch's result and its sets read that.

Here no keys are left to check positives against: a row said to be new is new; of the rows said to be seen the share
``rate`` in ``fresh``'s result is expected to be wrong. Null and empty keys are no keys and come back as null.

    <path>/{batches,base}/...  the sets, by slot
    <path>/fresh/batch=<n>     the first rows of the batch's new keys, until the next compaction but one
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweir.functions.columns import ref
from tallyweir.llm import golomb
from tallyweir.llm.seen import SETS, WIDTH, build, hashes, packed, unpacked
from tallyweir.streaming.rollup import StateFiles, read_folders

#: Bytes of hashes of a batch that every task may be given.
CARRIED = 32 << 20

_ASKED = "slot bigint, shard bigint, hash binary, first binary"
_ANSWERS = "shard bigint, seen binary, rate double"
_FRESH = "hash bigint, first_order bigint, rate double"


def _load(column: pa.ChunkedArray) -> list[golomb.GolombSet]:
    return [golomb.GolombSet.from_bytes(b.as_buffer().to_pybytes()) for b in column]


def _gathered(key: tuple, group: pa.Table) -> pa.Table:
    """The hashes of a shard, in order, with the first row of each."""
    hash, order = unpacked(group, ["hash", "order"])
    return pa.table({"slot": [key[0].as_py()], "shard": [key[1].as_py()], "hash": [hash.tobytes()], "first": [order.tobytes()]})


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each set says of the hashes asked of its shard."""
    for batch in batches:
        shards, bits, rates = [], [], []
        for shard, coded, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            coded = golomb.GolombSet.from_bytes(coded.as_buffer().to_pybytes())
            values = golomb.reduced(np.frombuffer(asked.as_buffer(), np.int64), WIDTH)
            shards.append(shard)
            bits.append(np.packbits(golomb.contains(coded, values)).tobytes())
            rates.append(coded.false_rate)
        yield pa.record_batch([pa.array(shards, pa.int64()), pa.array(bits, pa.binary()), pa.array(rates, pa.float64())], names=["shard", "seen", "rate"])


def _new(key: tuple, asked: pa.Table, answers: pa.Table) -> pa.Table:
    """The hashes of a shard that no set has."""
    hash, order = unpacked(asked, ["hash", "first"])
    seen = np.zeros(len(hash), bool)
    for bits in answers.column("seen"):
        seen |= np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8), count=len(hash)).astype(bool)
    rate = sum(answers.column("rate").to_pylist(), 0.0)
    return pa.table({"hash": hash[~seen], "first_order": order[~seen], "rate": np.full(int((~seen).sum()), rate)})


def _united(key: tuple, sets: pa.Table) -> pa.Table:
    one = golomb.union(_load(sets.column("coded")))
    return pa.table({"slot": [key[0].as_py()], "shard": [key[1].as_py()], "n": [one.n], "coded": [one.to_bytes()]})


class KeyHistory:
    """``shards`` is fixed for the life of the folder: the keys expected in all, by ``seen.shards_for``."""

    def __init__(self, spark: SparkSession, path: str, shards: int, carried: int = CARRIED) -> None:
        self.spark, self.files, self.shards, self.carried = spark, StateFiles(spark, path), shards, carried
        self._schema = StructType.fromDDL(SETS)

    def _read(self, paths: list[str], slots: list[int] | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._schema)
        sets = read_folders(self.spark, self._schema, paths)
        return sets if slots is None else sets.where(F.col("slot").isin(slots))

    def _fresh_path(self, batch: int) -> str:
        return f"{self.files.path}/fresh/batch={batch}"

    def learn(self, rows: DataFrame, key: str, batch: int) -> None:
        """Adds the keys of rows without asking, such as those of a log; batches are numbered upwards from 0."""
        self.files.append(build(hashes(rows, ref(key)), self.shards, by_slot=True), batch, ["slot"])

    def fresh(self, rows: DataFrame, key: str, order: str, batch: int) -> DataFrame:
        """(hash, first_order, rate): the keys of the batch that no earlier batch had, the least ``order`` of each, and
        the expected rate of wrong answers for keys of that shard."""
        mine = hashes(rows, ref(key), ref(order).cast("bigint").alias("order")).where("order is not null")
        # one row a shard; written, as the size decides how it travels and its slots what is read
        at = f"{self._fresh_path(batch)}-asked"
        packed(mine, self.shards).repartition("slot").groupBy("slot", "shard").applyInArrow(_gathered, _ASKED).write.mode("overwrite").parquet(at)
        asked = self.spark.read.schema(_ASKED).parquet(at)
        known = asked.groupBy("slot").agg(F.sum(F.octet_length("hash")).alias("size")).collect()  # at most SLOTS rows
        base, batches = self.files.live()
        paths = [self.files.base_path(base)] if base is not None else []
        paths += [self.files.batch_path(b) for b in batches if b < batch]
        sets = self._read(paths, [r["slot"] for r in known])
        question = asked.select(F.col("shard").alias("asked_shard"), F.col("hash").alias("asked"))
        if sum(r["size"] for r in known) <= self.carried:
            question = F.broadcast(question)
        answers = sets.join(question, F.col("shard") == F.col("asked_shard")).select("shard", "coded", "asked").mapInArrow(_answered, _ANSWERS)
        return asked.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_new, _FRESH)

    def probe(self, rows: DataFrame, key: str, order: str, batch: int) -> DataFrame:
        """``rows`` with ``seen``: whether the key occurred in an earlier batch or in an earlier row of this one by the
        unique column ``order``, an integer; null without a key or an order. Stores the batch's new keys.

        New keys are taken away by the order of their first rows, so a heavy key is no heavy join key.
        """
        base, _ = self.files.live()
        if base is not None and batch <= base:
            raise ValueError(f"batch {batch} is part of the compacted history up to {base}")
        self.fresh(rows, key, order, batch).write.mode("overwrite").parquet(self._fresh_path(batch))
        self.files.fs.drop(f"{self._fresh_path(batch)}-asked")
        fresh = self.spark.read.schema(_FRESH).parquet(self._fresh_path(batch))
        self.files.append(build(fresh, self.shards, by_slot=True), batch, ["slot"])
        new = fresh.select("first_order", F.lit(False).alias("new"))
        out = rows.join(new, ref(order) == F.col("first_order"), "left").drop("first_order")
        return out.withColumn("seen", F.when((ref(key) != "") & ref(order).isNotNull(), F.coalesce("new", F.lit(True)))).drop("new")

    def compact(self) -> None:
        """One set a shard. The first rows of batches before the last compaction are dropped; results still to be read
        need those after it."""
        base, batches = self.files.live()
        if batches:
            stored = self._read(self.files.paths()).repartition("slot").groupBy("slot", "shard").applyInArrow(_united, SETS)
            self.files.replace(stored, batches[-1], ["slot"])
            for name in self.files.fs.names(f"{self.files.path}/fresh"):
                if base is not None and int(name.removeprefix("batch=").removesuffix("-asked")) <= base:
                    self.files.fs.drop(f"{self.files.path}/fresh/{name}")

    def size(self) -> tuple[int, int]:
        """Keys and bytes kept."""
        n, size = self._read(self.files.paths()).agg(F.sum("n"), F.sum(F.octet_length("coded"))).first()
        return n or 0, size or 0

"""Rollups of a stream, kept as mergeable states in files.

Each micro-batch is aggregated to one state row per key and written under its batch number, replacing what an earlier
attempt at the same batch left, so a batch that runs twice counts once. Readers merge the states. Compaction merges all
states up to a batch into one base; until the base is complete readers use the parts. What is written per batch is
proportional to the keys of the batch, not to all keys, and no state lives in memory.

    <path>/batches/batch=<n>/*.parquet
    <path>/base/upto=<n>/*.parquet
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyweir.functions.columns import ref
from tallyweir.plans import collate as c
from tallyweir.plans.spec import Rollup
from tallyweir.sources.files import Files


class StateFiles:
    """Numbered batches of rows and compacted bases in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Files(spark)

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """The numbers of complete folders."""
        names = [n for n in self.fs.names(f"{self.path}/{folder}") if n.startswith(prefix)]
        return sorted(int(n.removeprefix(prefix)) for n in names if self.fs.exists(f"{self.path}/{folder}/{n}/_SUCCESS"))

    def base_path(self, upto: int) -> str:
        return f"{self.path}/base/upto={upto}"

    def batch_path(self, batch: int) -> str:
        return f"{self.path}/batches/batch={batch}"

    def live(self) -> tuple[int | None, list[int]]:
        """The newest base and the batches after it."""
        bases = self._numbers("base", "upto=")
        base = bases[-1] if bases else None
        return base, [b for b in self._numbers("batches", "batch=") if base is None or b > base]

    def paths(self) -> list[str]:
        base, batches = self.live()
        return ([self.base_path(base)] if base is not None else []) + [self.batch_path(b) for b in batches]

    def append(self, rows: DataFrame, batch: int, by: Sequence[str] = ()) -> None:
        """``by``: columns whose values become folders, so that readers may skip files."""
        base, _ = self.live()
        if base is None or batch > base:  # else it is part of the base already
            rows.write.mode("overwrite").parquet(self.batch_path(batch), partitionBy=list(by) or None)

    def read(self) -> DataFrame | None:
        paths = self.paths()
        return self.spark.read.parquet(*paths) if paths else None

    def replace(self, rows: DataFrame, upto: int, by: Sequence[str] = ()) -> None:
        """Makes ``rows`` the base of all batches up to that number. What it stands for stays until the next
        replacement, so readers that were planned before find their files."""
        previous, _ = self.live()
        rows.write.mode("overwrite").parquet(self.base_path(upto), partitionBy=list(by) or None)
        if previous is not None and previous != upto:
            for b in self._numbers("batches", "batch="):
                if b <= previous:
                    self.fs.drop(self.batch_path(b))
            for b in self._numbers("base", "upto="):
                if b < previous:
                    self.fs.drop(self.base_path(b))


def read_folders(spark: SparkSession, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
    """The rows of folders that are partitioned by columns of the schema; empty folders are allowed."""
    parents = dict.fromkeys(path.rpartition("/")[0] for path in paths)
    read = [spark.read.schema(schema).option("basePath", parent).parquet(*(x for x in paths if x.rpartition("/")[0] == parent)) for parent in parents]
    return reduce(DataFrame.unionByName, (x.select(*(ref(n) for n in schema.names)) for x in read))


class RollupTable:
    def __init__(self, spark: SparkSession, path: str, rollup: Rollup, compact_every: int = 20) -> None:
        self.files, self.rollup, self.compact_every = StateFiles(spark, path), rollup, compact_every

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds the rows of a batch; a second time for the same number changes nothing."""
        self.append_states(c.state(rows, self.rollup), batch)

    def append_states(self, states: DataFrame, batch: int) -> None:
        self.files.append(states, batch)
        if len(self.files.live()[1]) >= self.compact_every:
            self.compact()

    def states(self) -> DataFrame | None:
        stored = self.files.read()
        return None if stored is None else c.merge(stored, self.rollup)

    def compact(self) -> None:
        base, batches = self.files.live()
        if batches:
            self.files.replace(self.states(), batches[-1])

    def read(self, keys: Sequence[str] | None = None) -> DataFrame:
        """The measures of each key as of the last complete batch; with ``keys``, of each combination of these keys of
        the rollup alone, from the same states."""
        stored = self.files.read()
        if stored is None:
            raise LookupError(f"nothing has been written for {self.rollup.name}")
        wanted = self.rollup if keys is None else c.coarser(self.rollup, keys)
        return c.finish(c.merge(stored, wanted), wanted)


def append_all(rows: DataFrame, tables: Sequence[RollupTable], batch: int) -> None:
    """Adds the rows of a batch to all tables. They are read and aggregated once for all rollups; what is cached is the
    states."""
    if len(tables) == 1:
        return tables[0].append(rows, batch)
    rollups = [t.rollup for t in tables]
    states = c.states_many(rows, rollups).persist()
    try:
        for i, table in enumerate(tables):
            table.append_states(c.states_of(states, rollups, i), batch)
    finally:
        states.unpersist()


def keep(stream: DataFrame, tables: Sequence[RollupTable], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """One query that keeps all tables, by ``append_all``."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: append_all(rows, tables, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live(stream: DataFrame, rollup: Rollup) -> DataFrame:
    """The rollup as a streaming aggregation for the output modes ``update`` and ``complete``; its state is in Spark's
    state store (choose the RocksDB provider for many keys)."""
    return c.collate(stream, rollup)

"""The pane operator on a stream: windows corrected by late rows, re-emitted only where something changed.

Each micro-batch adds its partial aggregates by (keys, pane, arrival slice) to files under the batch's number, so a batch
that runs twice counts once. Then the windows over the panes that the batch touched are composed again and handed on.
Panes lie in folders by *era*, a stretch of event time, so only the folders that the touched windows need are read; the
touched windows are picked before anything is merged. Rows that came after their last window was closed go to
``closed_rows`` with all their columns.

Compaction moves the *clock* to the newest arrival slice seen. Windows whose cut-off the clock has passed become rows of
merged aggregates by window (``finals``, which are only ever added to), and panes without an open window are dropped, so
the panes that compaction rewrites are those of open windows however long the stream runs. The cut-off is judged by the
receive time of each row: a row that was received in time but reaches the stream after its window became final is merged
into that window all the same, and the window is emitted again.

    <path>/panes/{batches,base}/...   panes since the last compaction, and panes of windows open then
    <path>/finals/upto=<n>/era=<e>    final windows, and corrections of earlier ones, of the compaction up to batch n
    <path>/clock/upto=<n>             the clock of that compaction
    <path>/closed/batch=<n>           rows that came too late
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyweir.functions.columns import ref
from tallyweir.operators import panes as p
from tallyweir.sources.files import Files
from tallyweir.streaming.rollup import StateFiles, read_folders

#: A batch that touches more eras than this reads all of them; the driver gets one number an era.
MAX_ERAS = 4096


class PaneStream:
    """``grace``: microseconds that the clock is held back, if rows reach the stream much later than they are received;
    it changes what is kept, not the results. ``era``: microseconds of a folder, by default seven panes or one window."""

    def __init__(self, spark: SparkSession, path: str, windows: p.Windows, keys: Sequence[str], partials: dict[str, tuple[Column, str]], event: str = "data_time", arrival: str = "receive_time", compact_every: int = 20, grace: int = 0, era: int | None = None) -> None:
        self.spark, self.path, self.fs = spark, path.rstrip("/"), Files(spark)
        self.files = StateFiles(spark, f"{self.path}/panes")
        self.closed_path = f"{self.path}/closed"
        self.windows, self.keys, self.partials = windows, list(keys), partials
        self.event, self.arrival, self.compact_every = event, arrival, compact_every
        self._named: dict[str, T.StructField] | None = None
        self.grace, self.era = grace, era or max(7 * windows.pane, windows.size)

    def process(self, rows: DataFrame, batch: int) -> DataFrame:
        """Stores a batch and returns the windows that it changed, as they are now."""
        delta = p.pane_table(rows, self.windows, self.keys, self.partials, self.event, self.arrival)
        self._remember(delta.schema)
        self.files.append(self._with_era(delta, "pane_us"), batch, ["era"])
        p.closed_rows(rows, self.windows, self.event, self.arrival).write.mode("overwrite").parquet(f"{self.closed_path}/batch={batch}")
        stored = self.files.batch_path(batch)
        return self.changed(self._read([stored]) if self.fs.exists(stored) else delta)

    def changed(self, delta: DataFrame) -> DataFrame:
        """The windows over the panes of ``delta``, as they are now."""
        touched = p.over_windows(delta, self.windows).select(*self._keys(), "window_us").distinct()
        return self._composed(self._contributions(self._eras(touched)), touched)

    def final(self) -> DataFrame:
        """All windows as known now."""
        if not self.fs.exists(f"{self.path}/schema"):
            raise LookupError("nothing has been processed")
        return self._composed(self._contributions(), None)

    def compact(self) -> None:
        """Makes the windows final whose cut-off has passed, and drops the panes that only they needed."""
        base, batches = self.files.live()
        if not batches:
            return
        upto, before = batches[-1], self._clock(base)
        newest = self._read([self.files.batch_path(b) for b in batches]).agg(F.max("slice_us")).first()[0]
        clock = max((c for c in (before, newest) if c is not None), default=None)
        self.fs.write(f"{self.path}/clock/upto={upto}", str("" if clock is None else clock).encode())
        panes = self._read(self.files.paths())
        if clock is None:
            final, kept = None, panes
        else:
            late = F.lit(self.grace - clock)
            final = self._open_contributions(base, batches).where(self.windows.cut_off(F.col("window_us")) + late <= 0)
            kept = panes.where(self.windows.last_end(F.col("pane_us")) + F.lit(self.windows.lateness) + late > 0)
        if final is not None:
            merged = final.groupBy(*self._keys(), "window_us").agg(*(p._merged(n, how) for n, (_, how) in self.partials.items()))
            self._with_era(merged, "window_us").write.mode("overwrite").partitionBy("era").parquet(f"{self.path}/finals/upto={upto}")
        self.files.replace(self._with_era(p.merge_panes(kept, self.keys, self.partials), "pane_us"), upto, ["era"])

    def start(self, stream: DataFrame, emit: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
        """``emit`` gets the changed windows of each batch and its number; it may get them again after a failure."""

        def write(rows: DataFrame, batch: int) -> None:
            rows.persist()
            try:
                emit(self.process(rows, batch), batch)
                if len(self.files.live()[1]) >= self.compact_every:
                    self.compact()
            finally:
                rows.unpersist()

        writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    # --- what is stored

    def _keys(self) -> list[Column]:
        return [ref(k) for k in self.keys]

    def _with_era(self, df: DataFrame, time: str) -> DataFrame:
        return df.withColumn("era", F.floor(F.col(time) / F.lit(self.era)).cast("bigint"))

    def _remember(self, schema: T.StructType) -> None:
        """The schema of the panes, as a table without rows: a folder of a batch without panes has no file."""
        if self._named is None and not self.fs.exists(f"{self.path}/schema/_SUCCESS"):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/schema")

    def _schema(self, *times: str) -> T.StructType:
        if self._named is None:
            self._named = {f.name: f for f in self.spark.read.parquet(f"{self.path}/schema").schema}
        named = self._named
        fields = [named[k] for k in self.keys] + [T.StructField(t, T.LongType()) for t in times] + [named[n] for n in self.partials]
        return T.StructType([*fields, T.StructField("era", T.LongType())])

    def _read(self, paths: list[str], eras: list[int] | None = None, times: tuple[str, ...] = ("pane_us", "slice_us")) -> DataFrame:
        rows = read_folders(self.spark, self._schema(*times), paths)
        return rows if eras is None else rows.where(F.col("era").isin(eras))

    def _clock(self, base: int | None) -> int | None:
        if base is None:
            return None
        text = self.fs.read(f"{self.path}/clock/upto={base}").decode()
        return int(text) if text else None

    def _eras(self, touched: DataFrame) -> list[int] | None:
        """The eras of the panes of these windows; None if they are too many to name."""
        first = F.floor(F.col("window_us") / F.lit(self.era)).cast("bigint")
        last = F.floor((F.col("window_us") + F.lit(self.windows.size - 1)) / F.lit(self.era)).cast("bigint")
        found = touched.select("window_us").distinct().select(F.explode(F.sequence(first, last)).alias("era")).distinct()
        eras = [r["era"] for r in found.limit(MAX_ERAS + 1).collect()]
        return eras if len(eras) <= MAX_ERAS else None

    def _open_contributions(self, base: int | None, batches: list[int], eras: list[int] | None = None) -> DataFrame:
        """A row for each pane, slice and window: of the base for windows that were open at its clock, of the batches
        after it for all."""
        parts = [p.over_windows(self._read([self.files.batch_path(b) for b in batches], eras), self.windows)] if batches else []
        if base is not None:
            kept, clock = p.over_windows(self._read([self.files.base_path(base)], eras), self.windows), self._clock(base)
            if clock is not None:
                kept = kept.where(self.windows.cut_off(F.col("window_us")) + F.lit(self.grace) > F.lit(clock))
            parts.append(kept)
        columns = [*self._keys(), F.col("window_us"), *(ref(n) for n in self.partials)]
        return reduce(DataFrame.unionByName, (part.select(*columns) for part in parts))

    def _contributions(self, eras: list[int] | None = None) -> DataFrame:
        """Rows of partial aggregates by window, which together are the windows as known now."""
        base, batches = self.files.live()
        out = self._open_contributions(base, batches, eras)
        names = [n for n in self.fs.names(f"{self.path}/finals") if n.startswith("upto=") and base is not None and int(n.removeprefix("upto=")) <= base]
        if names:
            out = out.unionByName(self._read([f"{self.path}/finals/{n}" for n in names], eras, ("window_us",)).drop("era"))
        return out

    def _composed(self, parts: DataFrame, touched: DataFrame | None) -> DataFrame:
        if touched is not None:
            a, b, same = parts.alias("a"), touched.alias("b"), F.lit(True)
            for k in (*self.keys, "window_us"):
                name = "`" + k.replace("`", "``") + "`"
                same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
            parts = a.join(b, same, "left_semi")
        return p.composed(parts, self.windows, self.keys, self.partials)

"""Long exact spans shared between records, by super-k-mer partitioning.

1. Every text is turned into super-k-mers (``superkmers``) in the task that reads it. Each goes as one packed string,
   with the least and greatest record that has it, to the bucket of its minimiser. Equal ones of a batch go once, so
   copies are combined before the shuffle.
2. A bucket is read in the order of the minimisers, a bounded number of characters at a time; its windows are sorted and
   those that occur in two records marked. A mark is (minimiser, fingerprint of the super-k-mer, first and last marked
   window in it).
3. Marks are joined with the super-k-mers' places by (minimiser, fingerprint), 32 bytes a super-k-mer and no text, and
   the marked stretches of each record are united.

Minimisers that are very common are not sent to one bucket. The ``MAX_HOT`` most common of those with more than
``HOT`` occurrences are known before step 1: each task sends on those that are one in ``RARE`` of its super-k-mers at
least, a summary of bounded size, and the driver gets at most MAX_HOT numbers. Their windows are counted by their 128-bit fingerprints in a Spark aggregation that combines before its shuffle. Any other minimiser that
turns out to have more than ``CHUNK`` characters of different super-k-mers in its bucket is handed to the same
aggregation while it streams through, so no task gathers an unbounded group.

Records are told apart by the id column; rows with a null id are no records and take no part. Rows with one id count as
one record. Null, empty and short texts have no spans. A span repeated inside one record only is not shared. Positions
count code points. Copies of whole texts are shared from end to end. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.columns import ref
from tallyweir.llm import superkmers as sk
from tallyweir.session import cut

CHUNK = 1 << 20
HOT, MAX_HOT = 50_000, 10_000
RARE, HELD = 1 << 14, 1 << 20

_COUNTS = "minimiser bigint, n bigint"
_PACKED = "minimiser bigint, print bigint, packed string, low bigint, high bigint"
_PLACES = "minimiser bigint, print bigint, id bigint, begin bigint"
_MARKS = "minimiser bigint, print bigint, first int, last int, w1 bigint, w2 bigint, low bigint, high bigint"
_NAMES = [x.split()[0] for x in _MARKS.split(", ")]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Stretches of the texts of a batch, their records and beginnings, about CHUNK characters at a time."""
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ids):
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + CHUNK, side="right")))
        parts, owner, starts = sk.stretches(texts[begin:end].to_pylist())
        some, n = 0, 0
        for i, part in enumerate(parts):  # a text of many stretches is more than one helping
            n += len(part)
            if n >= CHUNK or i + 1 == len(parts):
                rows = slice(some, i + 1)
                yield parts[rows], ids[begin:end][owner[rows]], np.array(starts[rows])
                some, n = i + 1, 0
        begin = end


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, kind[k]) for c, k in zip(columns, kinds)], names=list(names))


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each run of equal keys begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def _added(parts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of counts by minimiser, of those that have at least so many."""
    minimisers, place = np.unique(np.concatenate([m for m, _ in parts]), return_inverse=True)
    counts = np.zeros(len(minimisers), np.int64)
    np.add.at(counts, place, np.concatenate([n for _, n in parts]))
    return minimisers[counts >= least], counts[counts >= least]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The minimisers that are at least one in ``RARE`` of the task's super-k-mers, with their counts. What is held is
    cut to these whenever it grows over ``HELD``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, total = 0, 0
    for batch in batches:
        for parts, _, _ in _parts(batch):
            found = sk.super_kmers(sk.Text.of(parts), prints=False)
            held.append(np.unique(found.minimiser, return_counts=True))
            size, total = size + len(held[-1][0]), total + len(found.minimiser)
            if size > HELD:
                held = [_added(held, total // RARE)]
                size = len(held[0][0])
    if held:
        yield _batch(_COUNTS, *_added(held, total // RARE))


def _window_rows(text: sk.Text, owner_minimiser: np.ndarray, owner_print: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each window of super-k-mers, with its 128-bit fingerprint."""
    at = text.windows()
    owner = text.text_at(at)
    (a,), (b,) = sk.hashes(text.points, (sk.SPAN,), 0), sk.hashes(text.points, (sk.SPAN,), 1)
    place = at - text.begins[owner]
    for i in range(0, len(at), 100_000):
        s = slice(i, i + 100_000)
        o = owner[s]
        yield _batch(_MARKS, owner_minimiser[o], owner_print[o], place[s], place[s], a[at[s]].view(np.int64), b[at[s]].view(np.int64), low[o], high[o])


def _pack(hot: np.ndarray, want_hot: bool):
    """Super-k-mers of minimisers that are not hot as packed strings; with ``want_hot``, the windows of the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, ids, _ in _parts(batch):
                found = sk.super_kmers(sk.Text.of(parts))
                mine = np.flatnonzero(np.isin(found.minimiser, hot) == want_hot)
                minimiser, fingerprint, owner = found.minimiser[mine], found.print[mine], found.text[mine]
                order, first = _distinct(minimiser, fingerprint)
                if not len(first):
                    continue
                one = order[first]
                low, high = np.minimum.reduceat(ids[owner[order]], first), np.maximum.reduceat(ids[owner[order]], first)
                begin, size = found.begin[mine][one].tolist(), (found.n_windows[mine][one] + sk.SPAN - 1).tolist()
                packed = [parts[t][b : b + n] for t, b, n in zip(owner[one].tolist(), begin, size)]
                if want_hot:
                    yield from _window_rows(sk.Text.of(packed), minimiser[one], fingerprint[one], low, high)
                else:
                    yield _batch(_PACKED, minimiser[one], fingerprint[one], packed, low, high)

    return run


def _runs(flags: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the first and last window of each run of marked neighbours."""
    marked = np.flatnonzero(flags)
    if not len(marked):
        return marked, marked
    cut_at = (np.diff(at[marked]) != 1) | (np.diff(owner[marked]) != 0)
    return marked[np.concatenate(([True], cut_at))], marked[np.concatenate((cut_at, [True]))]


def _settle(rows: pa.Table, spill: bool) -> Iterator[pa.RecordBatch]:
    """The marks of whole minimisers, or their windows."""
    minimiser, fingerprint, low, high = (rows.column(i).to_numpy() for i in (0, 1, 3, 4))
    order, first = _distinct(minimiser, fingerprint)
    if not len(first):
        return
    one = order[first]
    low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
    minimiser, fingerprint = minimiser[one], fingerprint[one]
    text = sk.Text.of(rows.column(2).take(pa.array(one)).to_pylist())
    if spill:
        yield from _window_rows(text, minimiser, fingerprint, low, high)
        return
    at, flags = sk.shared_windows(text, low, high)
    owner = text.text_at(at)
    a, b = _runs(flags, at, owner)
    if len(a):
        o, none = owner[a], pa.nulls(len(a), pa.int64())
        yield _batch(_MARKS, minimiser[o], fingerprint[o], at[a] - text.begins[o], at[b] - text.begins[o], none, none, none, none)


def _mark(chunk: int):
    """Super-k-mers in the order of their minimisers to marks; the windows themselves for too common minimisers."""

    step = max(1, min(2000, chunk // 200))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, flooded = 0, None
        for batch in batches:
            for some in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                held.append(some)
                n += pc.sum(pc.utf8_length(some.column(2))).as_py() or 0
                if n < chunk:
                    continue
                rows = pa.Table.from_batches(held)
                minimiser = rows.column(0).to_numpy()
                last = int(np.searchsorted(minimiser, minimiser[-1]))  # the last minimiser may go on
                if flooded is not None:
                    over = int(np.searchsorted(minimiser, flooded, side="right"))
                    yield from _settle(rows.slice(0, over), True)
                    yield from _settle(rows.slice(over, max(0, last - over)), False)
                    rest = rows.slice(max(over, last))
                else:
                    yield from _settle(rows.slice(0, last), False)
                    rest = rows.slice(last)
                flooded = None
                n = pc.sum(pc.utf8_length(rest.column(2))).as_py() or 0 if rest.num_rows else 0
                if n >= chunk:  # one minimiser alone is too much
                    yield from _settle(rest, True)
                    flooded, rest, n = minimiser[-1], rest.slice(0, 0), 0
                elif not rest.num_rows and last < len(minimiser):
                    flooded = minimiser[-1]  # it was all of the flooded one
                held = rest.to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            over = int(np.searchsorted(rows.column(0).to_numpy(), flooded, side="right")) if flooded is not None else 0
            yield from _settle(rows.slice(0, over), True)
            yield from _settle(rows.slice(over), False)

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for parts, ids, starts in _parts(batch):
            found = sk.super_kmers(sk.Text.of(parts))
            yield _batch(_PLACES, found.minimiser, found.print, ids[found.text], starts[found.text] + found.begin)


def _records(df: DataFrame, id: str, text: str) -> DataFrame:
    slim = df.select(ref(id).cast("bigint").alias("id"), ref(text).alias("text"))
    return slim.where((F.char_length("text") >= sk.SPAN) & F.col("id").isNotNull())


def shared_spans(df: DataFrame, id: str = "doc_id", text: str = "text", hot_over: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """id, span_start, span_end: the longest runs of characters that lie in spans of ``SPAN`` or more characters which
    occur in another record too. ``hot_over`` and ``chunk`` say where common minimisers go, not what comes out."""
    records = _records(df, id, text)
    counts = records.mapInArrow(_count, _COUNTS).groupBy("minimiser").agg(F.sum("n").alias("n")).where(F.col("n") > hot_over)
    hot = np.array([r["minimiser"] for r in counts.orderBy(F.desc("n")).limit(MAX_HOT).collect()], np.int64)

    packed = records.mapInArrow(_pack(hot, False), _PACKED).repartition("minimiser").sortWithinPartitions("minimiser")
    marked = cut(packed.mapInArrow(_mark(chunk), _MARKS))
    windows = marked.where("w1 is not null")
    if len(hot):
        windows = windows.unionByName(records.mapInArrow(_pack(hot, True), _MARKS))
    twice = windows.groupBy("w1", "w2").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("w1", "w2")
    single = windows.join(twice, ["w1", "w2"]).select("minimiser", "print", "first", "last").distinct()
    marks = marked.where("w1 is null").select("minimiser", "print", "first", "last").unionByName(single)

    places = records.mapInArrow(_places, _PLACES)
    found = places.join(marks, ["minimiser", "print"]).select(
        "id", (F.col("begin") + F.col("first")).alias("a"), (F.col("begin") + F.col("last") + F.lit(sk.SPAN)).alias("b")
    )
    return united(found)


def united(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans (id, a, b) of each record to runs."""
    order = Window.partitionBy("id").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(before.isNull() | (F.col("a") > before), 1).otherwise(0))
    numbered = new.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select("id", "span_start", "span_end")


def shared_share(df: DataFrame, spans: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, shared_chars, share for every row of ``df``; null texts have 0 characters, empty ones the share 0."""
    sums = spans.groupBy(F.col("id").alias("span_id")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("sum"))
    rows = df.select(ref(id).alias("id"), F.coalesce(F.char_length(ref(text)), F.lit(0)).cast("bigint").alias("n_chars"))
    out = rows.join(sums, rows["id"] == sums["span_id"], "left").withColumn("shared_chars", F.coalesce("sum", F.lit(0)))
    return out.select("id", "n_chars", "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"))

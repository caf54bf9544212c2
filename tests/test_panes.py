import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyweir.operators import panes as p
from tallyweir.streaming.panes import PaneStream

from .conftest import rows

SCHEMA = "id bigint, receive_time timestamp_ntz, data_time timestamp_ntz, key string, height double"
T = datetime(2024, 3, 1)


def _data(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = T + timedelta(seconds=rng.randrange(6 * 86400))
        late = rng.choice([1, 60, 3600, 86400, 3 * 86400, 4 * 86400, -600])
        got = at + timedelta(seconds=late * rng.random() if late > 0 else late)
        out.append((i, rng.choice([got, got, got, None]) if i % 11 == 0 else got, None if i % 37 == 0 else at, rng.choice(["a", "a", "b", None]), rng.choice([1.5, 2.25, None, float("nan")])))
    return out


def _expected(data, size, slide, lateness):
    """By window: number of rows, of values, sum; and the ids of closed rows."""
    sums, closed = defaultdict(lambda: [0, 0, 0.0]), []
    epoch = datetime(1970, 1, 1)
    for i, got, at, key, h in data:
        if got is None or at is None:
            continue
        first = (at - epoch) // slide * slide
        starts = [epoch + first - k * slide for k in range(size // slide + 1)]
        starts = [s for s in starts if s <= at < s + size]
        if all(got >= s + size + lateness for s in starts):
            closed.append(i)
        for s in starts:
            if got < s + size + lateness:
                w = sums[key, s]
                w[0] += 1
                if h is not None and h == h:
                    w[1] += 1
                    w[2] += h
    return sorted(((k, s, *v) for (k, s), v in sums.items()), key=repr), closed


def _windows(hours, slide, late):
    return p.Windows(hours * p.HOUR, slide * p.HOUR, late * p.HOUR)


@pytest.fixture(scope="module")
def table(spark):
    data = _data()
    return data, spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.mark.parametrize(("size", "slide", "late"), [(24, 24, 48), (24, 24, 0), (36, 24, 30), (72, 24, 48), (10, 4, 5)])
def test_final_windows_and_closed_rows(table, size, slide, late):
    data, df = table
    w, partials = _windows(size, slide, late), p.number_partials("height")
    expected, closed = _expected(data, *(timedelta(hours=h) for h in (size, slide, late)))
    panes = p.pane_table(df, w, ["key"], partials)
    got = [(r["key"], r["window_start"], r["n_rows"], r["n_values"], float(r["sum_value"] or 0)) for r in p.with_sums(p.final_windows(panes, w, ["key"], partials)).collect()]
    assert sorted(got, key=repr) == expected
    assert sorted(r["id"] for r in p.closed_rows(df, w).collect()) == closed


def test_revisions_end_at_the_final_value(table):
    _, df = table
    w, partials = _windows(36, 12, 30), p.number_partials("height")
    panes = p.pane_table(df, w, ["key"], partials)
    last = {}
    for r in p.revisions(panes, w, ["key"], partials).orderBy("revision").collect():
        key = (r["key"], r["window_start"])
        assert r["revision"] == last.get(key, (0,))[0] + 1
        assert r["n_rows"] > last.get(key, (0, 0))[1]
        last[key] = (r["revision"], r["n_rows"])
    final = {(r["key"], r["window_start"]): r["n_rows"] for r in p.final_windows(panes, w, ["key"], partials).collect()}
    assert {k: n for k, (_, n) in last.items()} == final


def test_portions_merge(table):
    _, df = table
    w, partials = p.Windows(), p.number_partials("height")
    whole = p.final_windows(p.pane_table(df, w, [], partials), w, [], partials)
    parts = [p.pane_table(df.where(F.col("id") % 2 == i), w, [], partials) for i in (0, 1)]
    merged = p.merge_panes(parts[0].unionByName(parts[1]), [], partials)
    assert rows(p.final_windows(merged, w, [], partials)) == rows(whole)


def test_verdicts_names_and_empty(spark):
    df = spark.createDataFrame([(1, None, T, "x", 1.0), (2, T + timedelta(hours=72), T, "x", 1.0), (3, T + timedelta(hours=72) - timedelta(microseconds=1), T, "x", 1.0)], SCHEMA)
    clash = df.withColumn("VERDICT", F.lit("mine"))
    got = p.sort_out(clash, p.Windows()).orderBy("id").collect()
    assert [r["verdict"] for r in got] == ["untimed", "closed", "in_time"] and got[0]["VERDICT_in"] == "mine"
    partials = p.number_partials("height")
    assert p.final_windows(p.pane_table(df.limit(0), p.Windows(), [], partials), p.Windows(), [], partials).count() == 0
    with pytest.raises(ValueError):
        p.Windows(size=1, slide=2)


def test_sums_leave_nothing_out(spark):
    values = [1e13, 1e-9, 0.1, 0.1, 1.5, -2e12, 3.0000001, -7.25, None, float("nan"), 1e300]
    for n, given in enumerate((values[:-1], values, [1e-9, None], [None, float("nan")], [float("inf"), 1.0])):
        df = spark.createDataFrame([(i, T, T, "x", v) for i, v in enumerate(given)], SCHEMA).repartition(3)
        partials = p.number_partials("height")
        r = p.with_sums(p.final_windows(p.pane_table(df, p.Windows(), [], partials), p.Windows(), [], partials)).first()
        numbers = [v for v in given if v is not None and v == v]
        assert (r["n_rows"], r["n_values"]) == (len(given), len(numbers))
        if numbers:
            assert r["sum_value"] == pytest.approx(math.fsum(numbers), rel=1e-15)
        else:
            assert r["sum_value"] is None
        assert r["n_inexact"] == [4, 5, 1, 0, 1][n]


def test_sums_do_not_depend_on_the_order(spark):
    rng = random.Random(4)
    values = [round(rng.uniform(-1e6, 1e6), rng.randrange(7)) for _ in range(3000)]
    exact = float(sum(map(lambda v: Decimal(repr(v)), values)))
    for parts in (1, 7):
        df = spark.createDataFrame([(i, T, T, "x", v) for i, v in enumerate(values)], SCHEMA).repartition(parts)
        partials = p.number_partials("height")
        r = p.with_sums(p.final_windows(p.pane_table(df, p.Windows(), [], partials), p.Windows(), [], partials)).first()
        assert (r["sum_value"], r["n_inexact"]) == (exact, 0)
        values.reverse()


def _streamed(spark, folder, data, windows, batches=8, **options):
    """A stream fed in order of arrival, and what each batch emitted."""
    stream = PaneStream(spark, str(folder), windows, ["key"], p.number_partials("height"), **options)
    step, out = -(-len(data) // batches), []
    for batch in range(batches):
        part = spark.createDataFrame(data[batch * step : (batch + 1) * step], SCHEMA)
        out.append(rows(stream.process(part, batch)))
        if len(stream.files.live()[1]) >= stream.compact_every:
            stream.compact()
    return stream, out


@pytest.mark.parametrize(("size", "slide", "late", "grace", "shuffled"), [(24, 24, 48, 0, False), (72, 24, 48, 12, True)])
def test_stream_emits_what_was_known(spark, tmp_path, size, slide, late, grace, shuffled):
    """Each batch emits the windows that it changed, as all rows so far give them; also rows that reach the stream long
    after they were received, when their window is final."""
    data, w, partials = _data(240, seed=5), _windows(size, slide, late), p.number_partials("height")
    data = random.Random(1).sample(data, len(data)) if shuffled else sorted(data, key=lambda r: (r[1] is None, r[1] or T))
    stream, emitted = _streamed(spark, tmp_path, data, w, 4, compact_every=2, grace=grace * p.HOUR)
    known = {}
    for batch, got in enumerate(emitted):
        so_far = p.final_windows(p.pane_table(spark.createDataFrame(data[: (batch + 1) * 60], SCHEMA), w, ["key"], partials), w, ["key"], partials)
        now = {(r[0], r[1]): r for r in rows(so_far)}
        delta = p.pane_table(spark.createDataFrame(data[batch * 60 : (batch + 1) * 60], SCHEMA), w, ["key"], partials)
        touched = {(r[0], r[1]) for r in rows(p.final_windows(delta, w, ["key"], partials))}
        assert got == sorted((now[k] for k in touched), key=repr)
        known |= {(r[0], r[1]): r for r in got}
    assert sorted(known.values(), key=repr) == rows(stream.final())


def test_stream_drops_closed_panes_and_prunes_its_reads(spark, tmp_path):
    data = [(i, T + timedelta(hours=6 * i + 1), T + timedelta(hours=6 * i), "a", 1.0) for i in range(400)]  # a hundred days
    stream, _ = _streamed(spark, tmp_path, data, p.Windows(), 5, compact_every=2)
    base, batches = stream.files.live()
    kept = spark.read.parquet(stream.files.base_path(base))
    assert (base, batches) == (3, [4]) and kept.select("pane_us").distinct().count() <= 4  # of eighty days
    more = spark.createDataFrame([(1000, T + timedelta(hours=2400), T + timedelta(hours=2399), "a", 1.0)], SCHEMA)
    changed = stream.process(more, 5)
    assert changed.count() == 1
    plan = changed._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "n_rows" in line]  # not those that find the touched windows
    assert len(scans) == 3 and all("era#" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans), plan
    assert len(stream._eras(p.over_windows(p.pane_table(more, p.Windows(), ["key"], stream.partials), p.Windows()))) == 1
    stream.compact()
    assert len(stream.files._numbers("batches", "batch=")) == 2  # the replaced batches stay for readers until the next one
    late = spark.createDataFrame([(1001, T + timedelta(hours=2), T + timedelta(hours=1), "a", 2.0)], SCHEMA)  # long under way
    r = p.with_sums(stream.process(late, 6)).collect()
    assert [(x["window_start"], x["n_rows"], x["sum_value"]) for x in r] == [(T, 5, 6.0)]
    assert stream.final().count() == 100


def test_stream_reemits_changed_windows_only(spark, tmp_path, table):
    data, df = table
    w, partials = _windows(72, 24, 48), p.number_partials("height")
    stream = PaneStream(spark, str(tmp_path / "state"), w, ["key"], partials)
    ordered = sorted(data, key=lambda r: (r[1] is None, r[1] or T))
    emitted = {}
    for batch in range(4):
        part = spark.createDataFrame(ordered[batch * 100 : (batch + 1) * 100], SCHEMA)
        for attempt in range(2):  # a batch that runs again counts once
            changed = stream.process(part, batch).collect()
        for r in changed:
            emitted[r["key"], r["window_start"]] = tuple(r)
        if batch == 2:
            stream.compact()
    final = p.final_windows(p.pane_table(df, w, ["key"], partials), w, ["key"], partials)
    assert sorted(emitted.values(), key=repr) == rows(final) == rows(stream.final())
    last = {(r["key"], r["window_start"]) for r in changed}
    assert 0 < len(last) <= len(emitted)
    closed = spark.read.parquet(stream.closed_path)
    assert sorted(r["id"] for r in closed.collect()) == sorted(r["id"] for r in p.closed_rows(df, w).collect())


def test_stream_source(spark, tmp_path, table):
    data, df = table
    w, partials = p.Windows(), p.number_partials("height")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept, seen = PaneStream(spark, str(tmp_path / "state"), w, [], partials, compact_every=3), []
    kept.start(source, lambda changed, batch: seen.extend(changed.collect()), str(tmp_path / "check"), available_now=True).awaitTermination()
    final = p.final_windows(p.pane_table(df, w, [], partials), w, [], partials)
    assert rows(kept.final()) == rows(final)
    assert {r["window_start"] for r in seen} == {r["window_start"] for r in final.collect()}

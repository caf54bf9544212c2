import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.functions import buckets, fnv, stats
from tallyweir.functions.columns import from_micros, micros
from tallyweir.operators import bloom, counters, hll, windowed

from .conftest import rows


@pytest.mark.parametrize(("text", "one", "one_a"), [("", 0xCBF29CE484222325, 0xCBF29CE484222325), ("a", 0xAF63BD4C8601B7BE, 0xAF63DC4C8601EC8C), ("foobar", 0x340D8765A4DDA9C2, 0x85944171F73967E8)])
def test_fnv_published_values(spark, text, one, one_a):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(fnv.fnv1(F.col("t")), fnv.fnv1a(F.col("t"))).first()
    assert [x & (1 << 64) - 1 for x in got] == [one, one_a]
    assert fnv.fnv_bytes(text.encode()) == one and fnv.fnv_bytes(text.encode(), True) == one_a


def test_fnv_kinds(spark):
    df = spark.createDataFrame([("é中", -3), (None, None), ("x" * 500, 2**62)], "t string, n bigint")
    for t, n, a, b in df.select("t", "n", fnv.fnv1(F.col("t")), fnv.fnv1a(F.col("n"), "bigint")).collect():
        if t is None:
            assert a is None and b is None
        else:
            assert a & (1 << 64) - 1 == fnv.fnv_bytes(t.encode())
            assert b & (1 << 64) - 1 == fnv.fnv_bytes((n & (1 << 64) - 1).to_bytes(8, "big"), True)


def test_fnv_in_pieces(spark):
    for first in (False, True):
        h = fnv.Fnv(first).update(b"foo").update("bär").update(-5)
        assert h.value == fnv.fnv_bytes(b"foo" + "bär".encode() + (2**64 - 5).to_bytes(8, "big"), first)
        h.reset()
        assert h.value == fnv.OFFSET
        f = fnv.fnv1a if first else fnv.fnv1
        df = spark.createDataFrame([("foo", "bär", -5), ("", "", 0), (None, "x", 1), ("x", "y", None)], "a string, b string, n bigint")
        got = df.select(f(F.col("n"), "bigint", f(F.col("b"), start=f(F.col("a"))))).collect()
        assert [None if r[0] is None else r[0] & 2**64 - 1 for r in got[:2]] == [fnv.fnv_bytes(b"foo" + "bär".encode() + (2**64 - 5).to_bytes(8, "big"), first), fnv.fnv_bytes(bytes(8), first)]
        assert got[2][0] is None and got[3][0] is None


@pytest.mark.parametrize("width", [1, 3, 4, 8])
def test_bucket_arrays(width):
    rng = np.random.default_rng(width)
    values = rng.integers(0, 300, 101)
    data = buckets.pack(values, width)
    assert len(data) == buckets.size(101, width)
    kept = buckets.unpack(data)
    assert (kept == np.minimum(values, 2**width - 1)).all()
    buckets.add(kept, 3, 1000, width)
    assert kept[3] == 2**width - 1 and buckets.count_of(kept, 2**width - 1) >= 1
    for bad in (data[:-1], data + b"x", b"\7" + data[1:], b""):
        with pytest.raises(ValueError):
            buckets.unpack(bad)
    assert len(buckets.unpack(buckets.pack(np.zeros(0), width))) == 0


def test_bucket_relation(spark):
    df = spark.createDataFrame([(0, 3), (0, 14), (1, 2), (5, 1), (-1, 1), (2, 0), (None, 1)], "b int, n int")
    table = counters.saturating_buckets(df, F.col("b"), F.col("n"), 4, 4)
    assert rows(table) == [(0, 15), (1, 2)]
    assert [counters.buckets_with(table, 4, v).first()[0] for v in (0, 2, 15, 7)] == [2, 1, 1, 0]


@pytest.mark.parametrize(("p", "d"), [(4, 8), (6, 100), (10, 40), (10, 4000), (14, 4000), (14, 40000)])
@pytest.mark.parametrize("short", [False, True])
def test_hll_accuracy(spark, p, d, short):
    """Within four theoretical standard errors, for long and for very short texts."""
    text = F.conv(F.col("id"), 10, 36) if short else F.sha2(F.col("id").cast("string"), 256)
    df = spark.range(d).select(text.alias("x")).unionAll(spark.range(d // 2).select(text.alias("x")))
    r = hll.estimates(hll.registers(df, [], F.col("x"), p), [], p).first()
    assert abs(r["estimate"] - d) <= 3 + 4 * 1.04 / math.sqrt(2**p) * d
    assert abs(r["improved"] - d) <= 3 + 4 * 1.04 / math.sqrt(2**p) * d


#: The published bounds of the standard error over ten seeds, for random values.
BOUNDS = (
    (4, 4, 1.1), (4, 8, 2.5), (4, 16, 4.0), (4, 40, 9.0), (4, 400, 100), (4, 4000, 1200),
    (10, 40, 1.2), (10, 400, 10), (10, 4000, 120), (10, 40000, 1200),
    (14, 40, 1.2), (14, 400, 2.6), (14, 4000, 20), (14, 40000, 400), (14, 400000, 3500),
    (16, 10, 1.2),
)


def test_hll_error_sweep(spark):
    """Other hashes than those of the bounds, so each may be passed by half, or reach twice the theory: the standard error
    of the harmonic estimator is 1.04 / sqrt(m) where it is not biased."""
    found = {(r["p"], r["d"]): r for r in hll.error_sweep(spark, [(p, d) for p, d, _ in BOUNDS]).collect()}
    assert len(found) == len(BOUNDS)
    for p, d, bound in BOUNDS:
        r, theory = found[p, d], 1.04 / math.sqrt(1 << p) * d
        assert r["estimate"] <= max(1.5 * bound, 2 * theory) + 1, (p, d)
        if d >= 5 << p:
            assert r["harmonic"] <= 2 * theory and r["improved"] <= 2 * theory
            assert r["harmonic"] >= theory / 4


def test_hll_bytes(spark):
    df = spark.createDataFrame([("a", i) for i in range(500)] + [("b", 7), (None, 8)], "k string, v bigint")
    regs = hll.registers(df, ["k"], F.col("v"), 8)
    stored = hll.to_bytes(regs, ["k"], 8)
    assert {len(r["sketch"]) for r in stored.collect()} == {hll.size(8)} == {2 + 10 + 192}
    assert rows(hll.from_bytes(stored, ["k"])) == rows(regs)
    twice = stored.unionByName(stored).unionByName(spark.createDataFrame([("a", None)], stored.schema))
    assert rows(hll.from_bytes(twice, ["k"])) == rows(regs)
    whole = hll.registers(df, [], F.col("v"), 6)
    assert rows(hll.from_bytes(hll.to_bytes(whole, [], 6), [])) == rows(whole)
    assert hll.to_bytes(regs.limit(0), ["k"], 8).count() == 0 == hll.from_bytes(stored.limit(0), ["k"]).count()
    data = bytes(stored.first()["sketch"])
    for bad in (data[:-1], data + b"x", b"\7" + data[1:], data[:1] + b"\7" + data[2:], data[:1] + b"\3" + data[2:], b"", b"\1"):
        with pytest.raises(ValueError):
            hll.unpack(bad)
    mixed = stored.unionByName(hll.to_bytes(hll.registers(df, ["k"], F.col("v"), 9), ["k"], 9))
    with pytest.raises(Exception, match="different precisions"):
        hll.from_bytes(mixed, ["k"]).collect()


def test_bloom_bytes(spark, tmp_path):
    shape = bloom.Shape(1000, 5)
    df = spark.createDataFrame([("foo",), ("bar",), (None,)], "v string")
    made = bloom.build(df, F.col("v"), shape)
    data = bloom.to_bytes(made, shape)
    again, same = bloom.from_bytes(spark, data)
    assert same == shape and rows(again) == rows(made) and len(data) == 10 + shape.size
    for bad in (data[:-1], data + b"x", b"\7" + data[1:], data[:1] + b"\0" + data[2:], data[:-1] + b"\xff", b""):
        with pytest.raises(ValueError):
            bloom.from_bytes(spark, bad)
    with pytest.raises(ValueError):
        bloom.to_bytes(made, bloom.Shape(bloom.IN_PLACE_BITS + 1, 2))
    bloom.save(made, shape, str(tmp_path / "f"))
    again, same = bloom.load(spark, str(tmp_path / "f"))
    assert same == shape and rows(again) == rows(made)
    assert rows(bloom.probe(df, F.col("v"), again, same).where("contained").select("v")) == [("bar",), ("foo",)]


def test_hll_union_nulls_and_limits(spark):
    a, b = (spark.range(n, n + 500).select(F.lit("k").alias("k"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("x")) for n in (0, 250))
    whole = hll.registers(a.unionAll(b), ["k"], F.col("x"), 12)
    joined = hll.union(*(hll.registers(t, ["k"], F.col("x"), 12) for t in (a, b)), ["k"])
    assert rows(whole) == rows(joined.select(*whole.columns))
    assert abs(hll.estimates(joined, ["k"], 12).first()["linear"] - 600) < 30
    assert hll.registers(a.limit(0), ["k"], F.col("x"), 12).count() == 0
    for p in (3, 19):
        with pytest.raises(ValueError):
            hll.registers(a, [], F.col("x"), p)


def test_hll_against_plain_python(spark):
    """Estimators from a histogram worked out by hand."""
    m, p, q = 1024, 10, 54
    rng = random.Random(4)
    regs = {i: min(q + 1, 1 + int(-math.log2(rng.random()))) for i in range(m) if rng.random() < 0.9}
    regs[0] = q + 1
    df = spark.createDataFrame(list(regs.items()), "idx int, rho int")
    got = hll.estimates(df, [], p).first()
    zero = m - len(regs)
    assert got["linear"] == math.ceil(m * math.log(m / zero))
    assert got["harmonic"] == math.ceil(hll.alpha(m) * m * m / (zero + sum(2.0**-r for r in regs.values())))

    def sigma(x):
        y, z = 1.0, x
        while True:
            x, last = x * x, z
            z, y = z + x * y, y * 2
            if z == last:
                return z

    def tau(x):
        y, z = 1.0, 1 - x
        while True:
            x, last = math.sqrt(x), z
            y /= 2
            z -= (1 - x) ** 2 * y
            if z == last:
                return z / 3

    counts = Counter(regs.values())
    z = m * tau(1 - counts[q + 1] / m)
    for k in range(q, 0, -1):
        z = (z + counts[k]) / 2
    assert got["improved"] == math.ceil(m * m / (2 * math.log(2)) / (z + m * sigma(zero / m)))


@pytest.mark.parametrize("m", [1 << 12, bloom.IN_PLACE_BITS + 1])
def test_bloom(spark, m):
    shape = bloom.Shape(m, 6)
    df = spark.createDataFrame([("foo",), ("",), (None,), ("foo",)], "v string")
    made = bloom.build(df, F.col("v"), shape)
    asked = spark.createDataFrame([("foo", 1), ("bar", 2), ("", 3), (None, 4), ("foo", 5)], "v string, contained int").withColumnRenamed("contained", "n")
    got = {r["n"]: r["contained"] for r in bloom.probe(asked, F.col("v"), made, shape).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
    assert bloom.estimates(made, shape).first()["n_items"] in (2, 3)  # rounded up
    assert 6 <= bloom.estimates(made, shape).first()["set_bits"] <= 12
    none = bloom.build(df.limit(0), F.col("v"), shape)
    assert not any(r["contained"] for r in bloom.probe(asked, F.col("v"), none, shape).collect())
    assert tuple(bloom.estimates(none, shape).first()) == (0, 0, 0.0)


def test_bloom_rate_and_union(spark):
    shape = bloom.Shape.for_items(20_000, 0.01)
    a, b = (bloom.build(spark.range(n, n + 10_000), F.col("id"), shape) for n in (0, 10_000))
    both = bloom.union(a, b)
    said = bloom.estimates(both, shape).first()
    assert abs(said["n_items"] - 20_000) < 400 and 0.005 < said["false_rate"] < 0.015
    wrong = bloom.probe(spark.range(10**6, 10**6 + 20_000), F.col("id"), both, shape).where("contained").count()
    assert wrong < 20_000 * 0.02
    assert bloom.probe(spark.range(20_000), F.col("id"), both, shape).where("contained").count() == 20_000
    assert (bloom.Shape.for_items(10**6, 0.01).m, bloom.Shape.for_items(10**6, 0.01).k) == (9585059, 7)


def test_counter_map(spark):
    df = spark.createDataFrame([(i, i * by) for i in range(1, 50) for by in (1, 2)] + [(None, 5)], "k int, n int")
    assert rows(counters.counter_map(df, F.col("k"), F.col("n"))) == sorted(((i, 3 * i) for i in range(1, 50)), key=repr)


def test_top_k(spark):
    df = spark.createDataFrame([("a", v) for v in "xxyyz"] + [("b", "q"), ("b", None)], "k string, v string")
    assert rows(counters.top_k(df, ["k"], F.col("v"), 2)) == [("a", 1, "x", 2), ("a", 2, "y", 2), ("b", 1, "q", 1)]
    assert rows(counters.top_k(df, [], F.col("v"), 3)) == [(1, "x", 2), (2, "y", 2), (3, "q", 1)]
    assert {tuple(r) for r in counters.top_k_approx(df, ["k"], F.col("v"), 1).collect()} <= {("a", "x", 2), ("a", "y", 2), ("b", "q", 1)}
    assert counters.top_k(df.limit(0), ["k"], F.col("v"), 2).count() == 0


def test_count_min(spark):
    sketch = counters.CountMin(64, 5)
    df = spark.range(3000).select((F.col("id") % 40).alias("v"))
    parts = [sketch.build(df.where(F.col("v") % 2 == i), F.col("v")) for i in (0, 1)]
    said = dict(rows(sketch.estimate(sketch.merge(*parts), df, F.col("v"))))
    assert set(said) == set(range(40)) and all(n >= 75 for n in said.values())
    assert sum(n - 75 <= math.e / 64 * 3000 for n in said.values()) >= 38
    assert rows(sketch.estimate(parts[0].limit(0), df.limit(1), F.col("v")))[0][1] == 0


def test_histogram_and_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 9.99, 10.0, 25.0, 1e9, float("nan"), None)], "x double")
    assert rows(counters.histogram(df, [], F.col("x"), 0.0, 10.0, 3)) == sorted([(-1, 1), (0, 2), (1, 1), (2, 1), (3, 1)], key=repr)
    assert counters.quantiles_approx(df, [], F.col("x"), [0.0, 0.5, 1.0]).first()[0] == [-1.0, 9.99, 1e9]


def test_statistics(spark):
    df = spark.createDataFrame([(v, e) for v, e in [(1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, None)]], "v double, e double")
    s = df.select(stats.mean_and_variance(F.col("v")).alias("s"), stats.error_of_estimate(F.col("v"), F.col("e")).alias("e")).first()
    assert tuple(s["s"]) == (4, 2.5, 1.25) and s["e"] == pytest.approx(math.sqrt(5.0))
    one = df.limit(1).select(stats.mean_and_variance(F.col("v")), stats.error_of_estimate(F.col("v"), F.col("e"))).first()
    assert tuple(one[0]) == (1, 1.0, None) and one[1] is None


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_times(spark, zone):
    """Times without a zone mean UTC in any session; some of these do not exist in New York."""
    moments = [datetime(1960, 1, 1, 0, 0, 0, 1), datetime(2024, 3, 31, 2, 30, 0, 999_999), datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30), datetime(1883, 1, 1), None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(t,) for t in moments], "t timestamp_ntz")
        for t, us, back in df.select("t", micros(F.col("t")), from_micros(micros(F.col("t")))).collect():
            assert back == t and (t is None or us == (t - datetime(1970, 1, 1)) // timedelta(microseconds=1))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_windows(spark):
    t = datetime(2024, 1, 1)
    events = [("a", t + timedelta(minutes=20 * i), f"u{i % 3}") for i in range(9)] + [("a", None, "u"), (None, t, "u")]
    df = spark.createDataFrame(events, "k string, ts timestamp_ntz, u string")
    count = {"n": F.count(F.lit(1))}
    hour = 3600 * 1_000_000
    assert rows(windowed.bucketed(df, ["k"], "ts", hour, count)) == [("a", t + timedelta(hours=h), 3) for h in range(3)]
    assert rows(windowed.windowed(df, ["k"], "ts", t, t + timedelta(hours=1), count)) == [("a", 2)]
    assert rows(windowed.lookback(df, ["k"], "ts", t + timedelta(hours=1), hour, count)) == [("a", 3)]
    sketches = windowed.bucket_sketches(df, ["k"], "ts", hour, F.col("u"))
    assert rows(windowed.uniques_between(sketches, ["k"], hour, t, t + timedelta(hours=2))) == [("a", 3)]
    assert windowed.uniques_between(sketches, ["k"], hour, t, t + timedelta(minutes=59)).count() == 0
    plan = windowed.windowed(df, [], "ts", t, t + timedelta(hours=1), count)._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(ts#" in plan and "cast(ts#" not in plan

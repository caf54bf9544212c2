import pytest
from pyspark.sql import functions as F

from tallyweir.plans import collate as c
from tallyweir.plans.dialect import QueryError, parse
from tallyweir.plans.engine import Engine, UnknownRollup, shown
from tallyweir.plans.measures import MEASURES, PARTS, Measure, Part, register
from tallyweir.plans.spec import MeasureSpec, Rollup, SpecError
from tallyweir.sources import observations as o
from tallyweir.streaming import rollup as s

from .conftest import rows


def m(*names):
    return tuple(MeasureSpec(*n.split(".")) for n in names)


ALL = m("count", "count.foo", "sum.foo", "mean.foo", "var.foo", "max.foo", "min.foo", "uniquecount.foo")


def one(spark, values, measures=ALL, keys=()):
    df = spark.createDataFrame([(v,) for v in values], "foo string")
    return c.collate(df, Rollup("r", keys, measures)).first()


def test_fixtures(spark):
    r = one(spark, ["4", "2", "9"])
    assert (r["count"], r["sum_foo"], r["mean_foo"], r["var_foo"], r["max_foo"], r["min_foo"], r["uniquecount_foo"]) == (3, 15, 5, 13, 9, 2, 3)
    r = one(spark, ["1", "4", "2", "6", "1", "7", "9", "3"])
    assert (r["count_foo"], r["sum_foo"], r["mean_foo"]) == (8, 33, 4.125) and r["var_foo"] == pytest.approx(8.696428571428571)
    assert tuple(one(spark, ["4"] * 15))[:3] == (15, 15, 60)
    greek = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    assert abs(one(spark, greek, (MeasureSpec("uniquecount", "foo", 6),))[0] - 12) <= 2


def test_missing_and_odd_values(spark):
    r = one(spark, ["-5", None, "x", "", " 1", "1d", "inf", "-7e0"])
    assert (r["count"], r["sum_foo"], r["max_foo"], r["min_foo"]) == (8, -12, -5, -7)
    assert r["count_foo"] == 7 and r["uniquecount_foo"] == 7  # any non-null text counts, '' too
    r = one(spark, [None, None])
    assert tuple(r) == (2, 0, None, None, None, None, None, 0)
    assert tuple(one(spark, [])) == (0, 0, None, None, None, None, None, 0)
    assert one(spark, ["3"])["var_foo"] is None
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "foo double")
    r = c.collate(nan, Rollup("r", (), m("max.foo", "min.foo"))).first()
    assert r[0] != r[0] and r[1] == 1.0


def test_keys(spark):
    df = spark.createDataFrame([("bar", None), (None, "bar"), ("bar", "bar"), ("", "bar")], "foo string, fuz string")
    assert rows(c.collate(df, Rollup("r", ("foo",), m("count")))) == [("", 1), ("bar", 2)]
    assert rows(c.collate(df, Rollup("r", ("foo", "fuz"), m("count")))) == [("", "bar", 1), ("bar", "bar", 1)]
    # values that run together are different keys
    close = spark.createDataFrame([("xk", ""), ("x", "k")], "foo string, fuz string")
    assert c.collate(close, Rollup("r", ("foo", "fuz"), m("count"))).count() == 2
    with pytest.raises(SpecError):
        c.collate(df, Rollup("r", ("fez",), m("count")))


@pytest.mark.parametrize("make", [lambda: MeasureSpec("median", "x"), lambda: MeasureSpec("sum"), lambda: MeasureSpec("uniquecount", "x", 3), lambda: Rollup("r"), lambda: Rollup("r", ("a", "a"), m("count")), lambda: Rollup("r", (), m("sum.x", "sum.x"))])
def test_definitions_that_make_no_sense(make):
    with pytest.raises(SpecError):
        make()


def test_merge_equals_whole(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("part"), (1e9 + F.col("id") * 0.5).alias("foo"))
    rollup, by_part = Rollup("r", ("k",), ALL), Rollup("p", ("k", "part"), ALL)
    whole = {r["k"]: r for r in c.collate(df, rollup).collect()}
    for r in c.finish(c.merge(c.state(df, by_part).drop("part"), rollup), rollup).collect():
        w = whole[r["k"]]
        assert r["var_foo"] == pytest.approx(w["var_foo"], rel=1e-9) and r["sum_foo"] == pytest.approx(w["sum_foo"])
        assert tuple(r)[:3] == tuple(w)[:3] and r["uniquecount_foo"] == w["uniquecount_foo"]
    none = c.merge(c.state(df.limit(0), Rollup("z", (), ALL)), Rollup("z", (), ALL))
    assert tuple(c.finish(none, Rollup("z", (), ALL)).first()) == (0, 0, None, None, None, None, None, 0)


def test_merge_of_many_uneven_states(spark):
    """A few thousand states of one key, of one to thousands of rows, two fields, far from 0."""
    n = F.when(F.col("part") % 50 == 0, 400).otherwise(F.col("part") % 4)
    df = spark.range(3000).withColumnRenamed("id", "part").withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    noise = F.pmod(F.xxhash64("part", "i"), F.lit(1000)) / 100
    df = df.select("part", (1e7 + noise).alias("foo"), (noise + F.col("part")).cast("decimal(18,2)").alias("bar"))
    both = m("count", "var.foo", "sum.bar", "var.bar", "mean.foo")
    whole, fine = c.collate(df, Rollup("w", (), both)).first(), Rollup("f", ("part",), both)
    states = c.state(df, fine)
    got = c.finish(c.merge(states, c.coarser(fine, [])), c.coarser(fine, [])).first()
    assert got["count"] == whole["count"] and got["sum_bar"] == whole["sum_bar"]
    for name in ("var_foo", "var_bar", "mean_foo"):
        assert got[name] == pytest.approx(whole[name], rel=1e-9)
    assert c.merge(states, fine).dtypes == states.dtypes  # so bases and batches of states may be read together


def _exchanged(plan):
    """What lies right below each exchange."""
    lines = [line.lstrip(" :+-*(0123456789)") for line in plan.splitlines()]
    return [b for a, b in zip(lines, lines[1:]) if a.startswith("Exchange")]


def test_merge_combines_before_each_shuffle(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], "k string, part int, foo double")
    fine = Rollup("r", ("k", "part"), ALL)
    states = spark.createDataFrame(c.state(df, fine).collect(), c.state(df, fine).schema)  # as read from files
    for keys in (["k", "part"], ["k"], []):
        coarse = c.coarser(fine, keys)
        plan = c.finish(c.merge(states, coarse), coarse)._jdf.queryExecution().executedPlan().toString()
        below = _exchanged(plan)
        assert "Window" not in plan and len(below) == 2
        assert all(b.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")) and "partial_" in b for b in below), plan


def test_many_rollups_from_one_scan(spark, tmp_path):
    data = [("a", "x", 1.0), ("a", None, 2.0), (None, "y", 4.0), ("b", "x", None)]
    df = spark.createDataFrame(data, "k string, l string, foo double")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rollups = [Rollup("k", ("k",), ALL), Rollup("kl", ("k", "l"), m("count", "sum.foo")), Rollup("all", (), m("count", "max.foo")), Rollup("few", ("l",), m("count.foo"), where=F.col("foo") > 1)]
    many = c.states_many(df, rollups)
    assert many._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for i, r in enumerate(rollups):
        assert rows(c.finish(c.states_of(many, rollups, i), r)) == rows(c.collate(df, r))
        assert rows(c.finish(c.states_of(c.states_many(df.limit(0), rollups), rollups, i), r)) == rows(c.collate(df.limit(0), r))
    with pytest.raises(SpecError):
        c.states_many(df, [Rollup("x", ("no",), m("count"))])


def test_kept_rollups_read_the_key_asked_for(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 5}", i, float(i)) for i in range(100)], "k string, part int, foo double")
    tables = [s.RollupTable(spark, str(tmp_path / n), Rollup(n, keys, ALL), compact_every=3) for n, keys in (("one", ("k",)), ("two", ("k", "part")))]
    for batch in range(5):
        for _ in range(2):  # a batch that runs again counts once
            s.append_all(df.where(F.col("part") % 5 == batch), tables, batch)
    engine = Engine()
    for t in tables:
        engine.create_kept(t)
        assert rows(t.read(["k"]).drop("var_foo", "uniquecount_foo")) == rows(c.collate(df, Rollup("x", ("k",), ALL)).drop("var_foo", "uniquecount_foo"))
    asked = engine.query("one", "select count(*), sum(foo) where k='k3'")
    assert tuple(asked.first()) == (20, sum(range(3, 100, 5)))
    assert "EqualTo(k,k3)" in asked._jdf.queryExecution().executedPlan().toString()
    assert engine.query("two", "select sum(foo) where k='k3' and part='8'").first()[0] == 8
    assert len(tables[0].files._numbers("batches", "batch=")) == 5  # what the only base stands for is kept until the next


def test_measures_share_their_parts():
    shared = c._parts(Rollup("r", (), m("sum.foo", "mean.foo", "var.foo", "count.foo")))
    assert sorted(shared) == ["foo__m2", "foo__n", "foo__present", "foo__sum"]


def test_own_measure(spark):
    register(Measure("longest", "text", ("longest",), lambda col: col("longest")), {"longest": Part(lambda x, p: F.max(F.length(x)), F.max)})
    try:
        assert one(spark, ["a", "abc", None], (MeasureSpec("longest", "foo"),))[0] == 3
        with pytest.raises(ValueError):
            register(Measure("longest", "text", (), lambda col: col))
    finally:
        del MEASURES["longest"], PARTS["longest"]


def test_sizes():
    assert Rollup("r", (), (MeasureSpec("uniquecount", "x", 10),)).bytes_per_key() == 780
    assert Rollup("r", (), m("count", "sum.x", "mean.x", "var.x", "max.x")).bytes_for(10) == 10 * (8 + 32 + 8)


QUERIES = [
    ("select sum(price) where customer='jim'", [("sum", "price")], [("customer", "jim")]),
    ("select sum(price), mean(quantity) where customer='jim'", [("sum", "price"), ("mean", "quantity")], [("customer", "jim")]),
    ("select sum(price),mean(quantity) where customer='jim'", [("sum", "price"), ("mean", "quantity")], [("customer", "jim")]),
    ("select sum(price) where customer='jim' and country='UK'", [("sum", "price")], [("customer", "jim"), ("country", "UK")]),
    ("select sum(price), mean(price) where customer='jim'", [("sum", "price"), ("mean", "price")], [("customer", "jim")]),
    ("SeLeCt sum(price) whERE customer='jim'", [("sum", "price")], [("customer", "jim")]),
    ("select count(*) where customer='jim jones' ", [("count", "*")], [("customer", "jim jones")]),
]


@pytest.mark.parametrize(("text", "measures", "criteria"), QUERIES)
def test_dialect(text, measures, criteria):
    for strict in (True, False):
        q = parse(text, strict)
        assert (list(q.measures), list(q.criteria)) == (measures, criteria)


@pytest.mark.parametrize("text", ["", "select sum(x)", "select sum(x) where", "where a='b'", "select sum x where a='b'", "select sum(x) where a=b", "select sum(x) where a='b' or c='d'", "select sum(x) where a=''", "select sum(x) where a = 'b'"])
def test_no_queries(text):
    with pytest.raises(QueryError):
        parse(text)


def test_engine(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.5), ("b", 1, -54.0), ("c", 1, 9078.0)], "k string, n int, x double")
    engine = Engine()
    engine.create_from(Rollup("k", ("k",), m("count", "max.x", "min.x", "var.x")), df)
    engine.create_from(Rollup("kn", ("k", "n"), m("count")), df)
    assert engine.names() == ["k", "kn"]
    assert rows(engine.query("k", "select max(x), count(*) where k='a'")) == [(4.5, 2)]
    assert engine.query("k", "select max(x) where k='zzz'").count() == 0
    assert engine.query("kn", "select count(*) where k='a'").count() == 0
    assert rows(engine.query("kn", "select count(*) where k='a'", partial_keys=True)) == [("a", 1, 1), ("a", 2, 1)]
    assert rows(engine.query("kn", "select count(*) where n='2' and k='a'")) == [(1,)]
    assert engine.query("kn", "select count(*) where n='two' and k='a'").count() == 0
    assert rows(engine.query("k", "select count(*) where k='a' and k='b'")) == [(2,)]  # the first value stands
    assert engine.answer("k", "select max(x), var(x), count(*) where k='c'") == "k=c\nmax(x)=9078\nvar(x)=NaN\ncount(*)=1\n"
    assert engine.answer("k", "select max(x) where k='zzz'") == "k=zzz\n"
    for bad in ("select median(x) where k='a'", "select max(x) where colour='red'"):
        with pytest.raises(SpecError):
            engine.query("k", bad)
    with pytest.raises(UnknownRollup):
        engine.query("none", "select count(*) where k='a'")
    engine.drop("kn")
    assert engine.names() == ["k"]


def test_key_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1.0)], "k string, x double").write.parquet(str(tmp_path / "t"))
    engine = Engine()
    engine.create_from(Rollup("k", ("k",), m("count")), spark.read.parquet(str(tmp_path / "t")))
    plan = engine.query("k", "select count(*) where k='a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan and "x#" not in plan


@pytest.mark.parametrize(("value", "text"), [(9078.0, "9078"), (-54.0, "-54"), (0.5, "0.5"), (1e21, "1e+21"), (1.5e-7, "1.5e-07"), (3, "3"), (float("nan"), "NaN"), (float("inf"), "+Inf"), (None, "0")])
def test_shown(value, text):
    assert shown(value) == text


LINES = [
    ("123|a=1|b", None, [("a", "1"), ("b", "")]),
    ("123", None, []),
    ("123|a=b=c", None, [("a", "b=c")]),
    ("123,a=1,", None, [("a", "1"), ("", "")]),
    ("123\\a=1\\b=2", None, [("a", "1"), ("b", "2")]),
    ("123.a=1.b=2", None, [("a", "1"), ("b", "2")]),
    ("123|", None, [("", "")]),
    ("1478566442000000|name=Toulouse|height=535", None, [("name", "Toulouse"), ("height", "535")]),
    ("a=1", o.REASONS[0], None),
    ("", o.REASONS[0], None),
    (None, o.REASONS[0], None),
    ("9" * 20, o.REASONS[1], None),
    ("123éa=1", o.REASONS[2], None),
]


def test_observation_lines(spark):
    df = spark.createDataFrame([(i, line) for i, (line, _, _) in enumerate(LINES)], "i int, value string")
    parsed = o.parse(df).orderBy("i").collect()
    for r, (line, reason, data) in zip(parsed, LINES):
        assert (r["reason"], r["data"] and [tuple(x) for x in r["data"]] or r["data"]) == (reason, data), line
    good, bad = o.split(o.parse(df))
    assert good.count() == 8 and bad.count() == 5 and "reason" not in good.columns


def test_fields_and_numbers(spark):
    df = spark.createDataFrame([([("a", "1"), ("a", "2"), ("b", "")],), ([],), (None,)], "data array<struct<f: string, v: string>>")
    assert [tuple(r) for r in df.select(o.field("a"), o.field("b"), o.field("z")).collect()] == [("1", "", None), (None,) * 3, (None,) * 3]
    texts = ["1", "-1.5e3", ".5", "5.", "1d", "inf", "NaN", " 1", "", "1e999", "0x1p2", None]
    numbers = spark.createDataFrame([(t,) for t in texts], "t string").select(o.number(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [1.0, -1500.0, 0.5, 5.0] + [None] * 8


def test_stream_of_lines_to_rollup(spark, tmp_path):
    folder = tmp_path / "posts"
    folder.mkdir()
    posts = [["1|k=a|x=1", "2|k=b|x=5", "bad"], ["3|k=a|x=3", "4|x=9"], ["5|k=a|x=nope"]]
    for i, post in enumerate(posts):
        (folder / f"{i}.txt").write_text("\n".join(post))
    rollup = Rollup("k", ("k",), m("count", "sum.x", "mean.x", "var.x", "uniquecount.x"))
    lines = o.stream_lines(spark, str(folder), 1)
    good, _ = o.split(o.parse(lines))
    kept = s.RollupTable(spark, str(tmp_path / "kept"), rollup, compact_every=2)
    run = lambda: s.keep(o.fields(good, ["k", "x"]), [kept], str(tmp_path / "check"), available_now=True).awaitTermination()
    run()
    assert rows(kept.read()) == [("a", 3, 4.0, 2.0, 2.0, 3), ("b", 1, 5.0, 5.0, None, 1)]
    (folder / "9.txt").write_text("6|k=b|x=7")
    run()
    assert rows(kept.read())[1] == ("b", 2, 12.0, 6.0, 2.0, 2)


def test_batch_that_runs_twice_counts_once(spark, tmp_path):
    kept = s.RollupTable(spark, str(tmp_path), Rollup("k", ("k",), m("count")))
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(LookupError):
        kept.read()
    for batch in (0, 0, 1):
        kept.append(df, batch)
    assert rows(kept.read()) == [("a", 4)]
    kept.compact()
    kept.append(df, 1)  # is in the base already
    assert rows(kept.read()) == [("a", 4)] and kept.files.live() == (1, [])
    kept.append(df, 2)
    kept.compact()
    assert rows(kept.read()) == [("a", 6)] and kept.files.live() == (2, [])


def test_states_answer_for_fewer_keys(spark, tmp_path):
    rollup = Rollup("r", ("k", "n"), ALL)
    kept = s.RollupTable(spark, str(tmp_path), rollup)
    df = spark.createDataFrame([("a", 1, 4.0), ("a", 2, 2.0), ("a", 2, 9.0), ("b", 1, None)], "k string, n int, foo double")
    kept.append(df.where("n = 1"), 0)
    kept.append(df.where("n = 2"), 1)
    assert rows(kept.read(["k"])) == [("a", 3, 3, 15.0, 5.0, 13.0, 9.0, 2.0, 3), ("b", 1, 0, None, None, None, None, None, 0)]
    assert tuple(kept.read([]).first())[:4] == (4, 3, 15.0, 5.0)
    with pytest.raises(SpecError):
        kept.read(["z"])


def test_live_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0)], "k string, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x double").parquet(str(tmp_path / "in"))
    q = s.live(stream, Rollup("k", ("k",), m("count", "mean.x", "uniquecount.x"))).writeStream.outputMode("update").format("memory").queryName("live_rollup").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("live_rollup")) == [("a", 2, 2.0, 2)]

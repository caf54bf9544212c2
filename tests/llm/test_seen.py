import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import golomb as g
from tallyweir.llm import seen

from ..conftest import rows


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 128, 1000, 50_000])
@pytest.mark.parametrize("width", [39, 64, 20])
def test_golomb_round_trip(n, width):
    rng = np.random.default_rng(n)
    values = g.reduced(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64), width)
    values = np.concatenate((values, values[: n // 3]))  # repeats
    coded = g.GolombSet.from_bytes(g.encode(values, width).to_bytes())
    assert (g.decode(coded, np.arange(len(coded.firsts))) == np.unique(values)).all()
    assert g.contains(coded, values).all()
    others = g.reduced(rng.integers(-(2**63), 2**63 - 1, 20_000, dtype=np.int64), width)
    assert (g.contains(coded, others) == np.isin(others, values)).all()


def test_golomb_uneven_gaps_and_union():
    far = np.array([0, 1, 2, 2**38, 2**39 - 1], np.uint64)
    near = np.arange(5000, dtype=np.uint64)
    both = g.union([g.encode(far, 39), g.encode(near, 39), g.encode(far[:0], 39)])
    assert both.n == 5002 and g.contains(both, far).all() and not g.contains(both, np.array([5000, 2**38 + 1], np.uint64)).any()


def test_golomb_size_and_rate():
    rng = np.random.default_rng(5)
    n, width = 1 << 16, 26  # one in 1024
    coded = g.encode(g.reduced(rng.integers(-(2**63), 2**63 - 1, n, dtype=np.int64), width), width)
    assert coded.size < n * 2  # 10 bits of the rate, 1.5 of the code, 2 of the index
    asked = g.reduced(rng.integers(-(2**63), 2**63 - 1, 400_000, dtype=np.int64), width)
    assert g.contains(coded, asked).mean() == pytest.approx(coded.false_rate, rel=0.2)


def _run(spark, log, stream, shards=3, epochs=4, width=seen.WIDTH):
    df = spark.createDataFrame(stream, "id bigint, key string").repartition(3)
    log = spark.createDataFrame(log, "key string").repartition(2)
    hashed = seen.hashes(df, F.col("key"), F.col("id"))
    probed = seen.probe(hashed, seen.build(seen.hashes(log, F.col("key")), shards, width), shards, epochs, width)
    return df, log, hashed, probed


def _expected(log, stream):
    known, out = {k for (k,) in log if k}, []
    for i, k in sorted((i, k) for i, k in stream if i is not None and k):
        if k in known:
            out.append((i,))
        known.add(k)
    return sorted(out, key=repr)


def _data(seed, n_log=300, n=900):
    rng = random.Random(seed)
    keys = [f"K{i}" for i in range(400)] + ["hot"] * 150 + ["", None, "hot ", "HOT", "é", "x" * 20_000]
    log = [(rng.choice(keys),) for _ in range(n_log)]
    stream = [(i * rng.choice([1, 1, 7]) * 1000 + i, rng.choice(keys)) for i in range(n)]
    return log, list({i: (i, k) for i, k in stream}.values()) + [(None, "K1")]


@pytest.mark.parametrize(("seed", "chunk"), [(0, 1 << 20), (1, 50), (2, 1)])
def test_seen_against_a_set(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(seen, "CHUNK", chunk)
    log, stream = _data(seed)
    df, known, hashed, probed = _run(spark, log, stream)
    assert rows(seen.seen(hashed, probed)) == _expected(log, stream)
    r = seen.audit(df, known, probed, 256).first()
    fresh = {k for i, k in stream if i is not None and k} - {k for (k,) in log}
    assert (r["audited"], r["false_positives"], r["missed"], r["within_limits"]) == (len(fresh), 0, 0, True)
    assert 0 < r["theoretical_rate"] < 1e-8


def test_audit_of_narrow_sets(spark):
    """Sets of few bits err as often as theory says, and only by taking new keys for seen ones."""
    log, stream = [(f"L{i}",) for i in range(3000)], [(i, f"S{i % 1500}") for i in range(2500)]
    df, known, hashed, probed = _run(spark, log, stream, 2, 3, seen.width_for(16, 2000))
    assert set(_expected(log, stream)) <= set(rows(seen.seen(hashed, probed)))
    r = seen.audit(df, known, probed, 256).first()
    assert r["audited"] == 1500 and 40 < r["false_positives"] < 200 and r["missed"] == 0 and r["within_limits"]
    part = seen.audit(df, known, probed).first()
    assert 250 < part["audited"] < 500 and part["within_limits"]
    # the audit sees sets that always say yes, and answers that are too sure
    yes = probed.withColumn("seen", F.lit(True))
    assert not seen.audit(df, known, yes).first()["within_limits"]
    no = probed.withColumn("seen", F.lit(False))
    assert seen.audit(df, known, no).first()["missed"] > 0 and not seen.audit(df, known, no).first()["within_limits"]


def test_audit_of_all_keys_and_without_answers(spark):
    """A whole audit decides each key; a new key whose first row got no answer counts as taken for a seen one, as ``seen`` does."""
    log, stream = [(f"L{i}",) for i in range(50)], [(i, f"S{i % 40}") for i in range(100)] + [(200 + i, f"L{i}") for i in range(20)]
    df, known, hashed, probed = _run(spark, log, stream)
    whole = seen.audit(df, known, probed, seen.ALL).first()
    assert (whole["audited"], whole["false_positives"], whole["missed"], whole["within_limits"]) == (40, 0, 0, True)
    some = probed.where("id >= 10")
    assert len(rows(seen.seen(hashed, some))) == len(_expected(log, stream)) + 10
    r = seen.audit(df, known, some, seen.ALL).first()
    assert (r["audited"], r["false_positives"], r["missed"], r["within_limits"]) == (40, 10, 0, False)


def test_sets_that_always_say_yes_fail(spark, monkeypatch):
    """The answer comes from the sets: when they are broken it is wrong."""
    log, stream = _data(7, 100, 300)
    hashed = seen.hashes(spark.createDataFrame(stream, "id bigint, key string"), F.col("key"), F.col("id"))
    run = seen._probe(seen.WIDTH)
    packed = pa.table(_packed(hashed))
    sets = pa.table({"coded": [g.encode(np.arange(5, dtype=np.uint64), seen.WIDTH).to_bytes()]})
    assert not all(run((), packed, sets)["seen"].to_pylist())
    monkeypatch.setattr(g, "contains", lambda coded, values: np.ones(len(values), bool))
    assert all(run((), packed, sets)["seen"].to_pylist())


def _packed(hashed):
    one = seen.packed(hashed.where("id is not null").select("hash", F.lit(0).cast("bigint").alias("epoch"), "id"), 1).collect()
    return {n: [bytes(r[n]) for r in one] for n in ("hash", "epoch", "id")}


def test_plan_knows_no_keys(spark):
    """No string is shuffled or joined; rows are packed before each exchange."""
    _, _, hashed, probed = _run(spark, *_data(3))
    plan = probed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning(shard") == 3  # hashes of the log, its sets, first rows
    assert not any("key" in line for line in plan.splitlines() if "Exchange" in line and "hashpartitioning" in line)


def test_empty(spark):
    for log, stream in (([], []), ([("a",)], []), ([], [(1, "a"), (2, "a")]), ([(None,), ("",)], [(1, ""), (2, None)])):
        df, known, hashed, probed = _run(spark, log, stream)
        assert rows(seen.seen(hashed, probed)) == _expected(log, stream)
        r = seen.audit(df, known, probed).first()
        assert r["within_limits"] and r["missed"] == 0


def test_first_value(spark):
    cases = [([("x", "1"), ("iata", "A"), ("iata", "B")], "A"), ([("iata", ""), ("iata", "B")], None), ([("iata", None)], None), ([], None), (None, None), ([(None, "A")], None)]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, data array<struct<f: string, v: string>>")
    got = [r[0] for r in df.orderBy("i").select(seen.first_value(F.col("data"), "iata")).collect()]
    assert got == [v for _, v in cases]


def test_shards_follow_the_size():
    assert seen.shards_for(0) == 1 and seen.shards_for(10**9) == 3815

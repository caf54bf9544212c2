import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweir.llm import percentiles
from tallyweir.llm.compactors import Sketch, shares

from ..conftest import rows

P = np.array([0, 10, 250, 500, 750, 990, 1000])


def _rank_errors(sketch, values):
    """How far the rank of each answer is from the one asked for, as a share of n."""
    values, n = np.sort(values), len(values)
    out = []
    for p, v in zip(P, sketch.quantiles(P)):
        want = max(1, -(-n * p // 1000))
        low, high = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
        out.append(max(0, low - want, want - high) / n)
    return max(out)


@pytest.mark.parametrize("make", [lambda r, n: r.normal(size=n), lambda r, n: np.arange(n, dtype=float), lambda r, n: r.integers(0, 5, n).astype(float), lambda r, n: np.exp(r.normal(size=n) * 20), lambda r, n: -np.arange(n, dtype=float)])
@pytest.mark.parametrize("n", [1, 7, 1000, 200_000])
def test_error_bound(make, n):
    rng = np.random.default_rng(n)
    values = make(rng, n)
    sketch = Sketch()
    for part in np.array_split(values, 13):
        sketch.add(part, rng)
    assert sketch.n == n and (sketch.low, sketch.high) == (values.min(), values.max())
    assert sum(len(x) << h for h, x in enumerate(sketch.levels)) == n  # weights add up
    assert _rank_errors(sketch, values) <= sketch.rank_error() <= 0.02
    assert sum(map(len, sketch.levels)) <= sum(shares(sketch.k, len(sketch.levels)))


def test_ranks_are_unbiased():
    values, ranks, bound = np.arange(20_000, dtype=float), [], []
    for seed in range(100):
        rng, sketch = np.random.default_rng(seed), Sketch(k=50)
        for part in np.array_split(values, 40):
            sketch.add(part, rng)
        ranks.append(sum(int((x < 10_000).sum()) << h for h, x in enumerate(sketch.levels)))
        bound.append(math.sqrt(sketch.spread))
    error = np.array(ranks) - 10_000
    assert abs(error.mean()) < 4 * error.std() / math.sqrt(100) + 1
    assert error.std() <= max(bound)


def test_merge_in_any_order_and_bytes():
    rng = np.random.default_rng(3)
    values = rng.normal(size=90_000)
    parts = []
    for part in np.array_split(values, 30):
        s = Sketch()
        s.add(part, rng)
        parts.append(Sketch.from_bytes(s.to_bytes()))
    left, tree = Sketch.from_bytes(parts[0].to_bytes()), [Sketch.from_bytes(p.to_bytes()) for p in parts]
    for p in parts[1:]:
        left.merge([p], rng)
    while len(tree) > 1:
        tree[0].merge(tree[1:3], rng)
        tree = [*tree[3:], tree[0]]
    for s in (left, tree[0]):
        assert s.n == 90_000 and _rank_errors(s, values) <= s.rank_error() <= 0.03


def test_small_inputs_are_exact():
    s = Sketch()
    s.add(np.arange(300, dtype=float), np.random.default_rng())
    assert s.rank_error() == 0 and s.quantiles(P).tolist() == [0, 2, 74, 149, 224, 296, 299]


def test_operator(spark):
    data = [("a", "d1", float(i)) for i in range(5000)] + [("a", "d2", float(i)) for i in range(5000, 6000)] + [("b", None, 1.0), (None, "d1", -0.0), ("b", "d1", None), ("c", "d1", float("nan")), ("b", "d1", float("inf"))]
    df = spark.createDataFrame(data, "g string, p string, x double").repartition(7)
    sketches = percentiles.portions(df, F.col("g"), F.col("p"), F.col("x"))
    assert sketches.count() == 5
    out = percentiles.combine(sketches, [0, 500, 1000], each_portion=True).collect()
    by = {(r["group"], r["portion"], r["permille"]): r for r in out}
    assert len(out) == 3 * (5 + 3) and not any(r["group"] == "c" for r in out)
    whole = by["a", "all", 500]
    assert whole["n"] == 6000 and abs(whole["value"] - 2999) <= whole["rank_error"] * 6000 + 1 and whole["rank_error"] < 0.05
    assert (by["a", "all", 0]["value"], by["a", "all", 1000]["value"]) == (0.0, 5999.0)
    assert by["a", "d2", 500]["n"] == 1000 and by[None, "all", 500]["value"] == 0.0
    assert (by["b", None, 500]["value"], by["b", "all", 1000]["value"]) == (1.0, float("inf"))
    # separately stored portions combine to the same counts
    one = percentiles.portions(df.where("p = 'd1'"), F.col("g"), F.col("p"), F.col("x"))
    rest = percentiles.portions(df.where("p is null or p != 'd1'"), F.col("g"), F.col("p"), F.col("x"))
    again = percentiles.combine(percentiles.merge_portions(one.unionByName(rest)), [500])
    assert sorted((r["group"], r["n"]) for r in again.collect() if r["group"]) == [("a", 6000), ("b", 2)]


def test_empty_and_many_partials(spark, monkeypatch):
    none = spark.createDataFrame([], "g string, p string, x double")
    assert percentiles.combine(percentiles.portions(none, F.col("g"), F.col("p"), F.col("x")), [500]).count() == 0
    df = spark.range(20_000).selectExpr("'g' g", "'p' p", "cast(id as double) x").repartition(80)  # more than FAN_IN sketches
    r = percentiles.combine(percentiles.portions(df, F.col("g"), F.col("p"), F.col("x")), [500]).first()
    assert r["n"] == 20_000 and abs(r["value"] - 9999) <= r["rank_error"] * 20_000 + 1


def test_a_task_that_runs_again_gives_the_same(spark):
    df = spark.range(50_000).selectExpr("'g' g", "'p' p", "cast(id * 7919 % 50000 as double) x").coalesce(1)
    runs = [rows(percentiles.portions(df, F.col("g"), F.col("p"), F.col("x")).select(F.md5("sketch"))) for _ in range(2)]
    assert runs[0] == runs[1]


def test_tasks_choose_independently(spark):
    """Sixty-four tasks with the same rows do not flip the same coins: their rank errors differ and mostly cancel."""
    n, tasks = 3000, 64
    df = spark.range(tasks, numPartitions=tasks).selectExpr("'g' g", "'p' p", "explode(sequence(0, 2999)) x")
    slim = df.selectExpr("g as group", "p as portion", "cast(x as double) as value")
    sketches = [Sketch.from_bytes(bytes(r["sketch"])) for r in slim.mapInArrow(percentiles._partial(100), percentiles._STATE).collect()]
    assert len(sketches) == tasks and all(s.n == n for s in sketches)
    errors = np.array([sum(int((x < 1000).sum()) << h for h, x in enumerate(s.levels)) - 1000 for s in sketches])
    spread = math.sqrt(np.mean([s.spread for s in sketches]))
    assert len(set(errors.tolist())) > 1
    assert abs(errors.sum()) <= 5 * spread * math.sqrt(tasks) < spread * tasks

import math
import random
from collections import Counter, defaultdict

import pytest

from tallyweir.operators import skew

from .conftest import rows


def _data(n=3000, seed=1):
    rng = random.Random(seed)
    keys = ["big"] * 6 + ["b", "c", "", None, "rare"]
    number = lambda: rng.choice([None, float("nan"), -0.0, 0.0, 1.5, float("inf"), -1e300, rng.gauss(0, 100), round(rng.gauss(500, 50), 1)])
    return [(rng.choice(keys), rng.choice(["x", "y", "z", "", None]), number()) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    data = _data()
    return data, spark.createDataFrame(data, "key string, value string, number double").repartition(5)


def test_measures(table):
    data, df = table
    by = defaultdict(Counter)
    for k, v, _ in data:
        by[k][v] += 1
    expected = []
    for k, counts in by.items():
        mode = min(((-n, v) for v, n in counts.items() if v is not None), default=None)
        values = sum(n for v, n in counts.items() if v is not None)
        expected.append((k, sum(counts.values()), values, len([v for v in counts if v is not None]), mode and mode[1], mode and -mode[0]))
    assert rows(skew.measures(df, "key", "value")) == sorted(expected, key=repr)


def test_heavy_keys(table):
    data, df = table
    counts = Counter(k for k, _, _ in data)
    expected = sorted(("key", k, n) for k, n in counts.items() if k is not None and n * 100 >= 9 * len(data))
    assert rows(skew.heavy_keys(df, ["key"], 9)) == expected


def test_percentiles(table):
    data, df = table
    by = defaultdict(list)
    for k, _, x in data:
        if x is not None and not math.isnan(x):
            by[k].append(x + 0.0)
    wanted = (0, 1, 250, 500, 999, 1000)
    expected = []
    for k, xs in by.items():
        xs.sort()
        expected += [(k, p, len(xs), xs[max(1, -(-len(xs) * p // 1000)) - 1]) for p in wanted]
    assert rows(skew.percentiles(df, "key", "number", wanted)) == sorted(expected, key=repr)


def test_buckets_are_monotone(spark):
    from pyspark.sql import functions as F

    xs = sorted([-math.inf, -1e308, -1e10, -1.0, -1e-300, 0.0, 5e-324, 1e-9, 1.0, 1.0000001, 7.5, 1e10, 1e308, math.inf])
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(skew._coarse(F.col("x")).alias("b"), "x").orderBy("x").select("b").collect()]
    assert got == sorted(got)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "key string, value string, number double")
    assert skew.measures(none, "key", "value").count() == 0
    assert skew.percentiles(none, "key", "number", (500,)).count() == 0
    assert skew.heavy_keys(none, ["key"], 4).count() == 0
    same = spark.createDataFrame([("a", "v", 2.0)] * 50, "key string, value string, number double")
    assert rows(skew.percentiles(same, "key", "number", (10, 990))) == [("a", 10, 50, 2.0), ("a", 990, 50, 2.0)]
    nulls = spark.createDataFrame([("a", None, None)] * 3, "key string, value string, number double")
    assert rows(skew.measures(nulls, "key", "value")) == [("a", 3, 0, 0, None, None)]
    assert skew.percentiles(nulls, "key", "number", (500,)).count() == 0


def test_names_with_dots(spark):
    df = spark.createDataFrame([("a", 1.0, "w")], "`k.y` string, `val``ue` double, weight string")
    assert rows(skew.percentiles(df, "k.y", "val`ue", (500,))) == [("a", 500, 1, 1.0)]


def test_no_task_gets_a_heavy_key(spark):
    """Rows reach the shuffle combined: the plan aggregates before each exchange."""
    df = spark.range(1000).selectExpr("'hot' key", "cast(id % 7 as string) value")
    plan = skew.measures(df, "key", "value")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("partial_sum") >= 2


def test_percentiles_of_values_that_hardly_differ(spark):
    """Thousands of neighbouring doubles, values near 0, and both signs: the refinement still parts them."""
    dense = [math.nextafter(1.0, 2.0, steps=i) for i in range(3000)]
    tiny = [sign * 1e-200 * (1 + i * 1e-9) for i in range(1500) for sign in (1, -1)] + [5e-324 * i for i in range(500)]
    data = [("d", v) for v in dense] + [("t", v) for v in tiny] + [("i", v) for v in (float("inf"), float("-inf"), 1e308, -1e308, 0.0)]
    df = spark.createDataFrame(data, "key string, number double").repartition(3)
    wanted, expected = (1, 500, 777, 1000), []
    for key in "dti":
        own = sorted(v for k, v in data if k == key)
        expected += [(key, p, len(own), own[max(1, -(-len(own) * p // 1000)) - 1]) for p in wanted]
    assert rows(skew.percentiles(df, "key", "number", wanted)) == sorted(expected, key=repr)

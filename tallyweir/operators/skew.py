"""Per-key measures where a few keys hold most rows: value-frequency compression.

Rows are grouped by key *and* value first. That grouping combines on the map side and spreads a heavy key over as many
shuffle partitions as it has values, so no task receives the rows of one key. What is left has one weighted row per
distinct (key, value); sums, distinct counts, modes and percentiles of a key are exact functions of those weights.

The second grouping, by key, combines on the map side as well: each task sends one row per key. Percentiles never sort
a key's values in one task. They are found by refining histograms: a logarithmic one whose rows per key are bounded by
the range of a double, then ``ROUNDS`` linear ones of ``FINE_BINS`` bins, each inside the bin of the one before that holds
the wanted rank. A logarithmic bucket leaves 43 of the 52 bits that tell doubles of one size apart, and two linear
rounds take 32 of those, so the values that are put in order at last are a few thousand at most, whatever the data.

Nulls: a null key is a key of its own in ``compress`` and ``measures`` (they count all rows) and never a heavy key.
Null values do not count as values; NaN does not count as a number. Ties of the mode go to the smallest value.
An empty table gives an empty result. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.columns import ref

#: Buckets per power of two: one bucket spans a factor of about 1.0014.
COARSE_PER_OCTAVE = 512
FINE_BINS = 1 << 16
ROUNDS = 2


def compress(df: DataFrame, keys: Sequence[str], value: str | None = None, weight: Column | None = None) -> DataFrame:
    """``keys`` as they are, ``value`` and ``weight``: the number of rows (or the sum of ``weight``) of each combination.

    Columns: k0, k1, ... and value (if asked for) and weight.
    """
    columns = [ref(k).alias(f"k{i}") for i, k in enumerate(keys)]
    columns += [ref(value).alias("value")] if value is not None else []
    names = [f"k{i}" for i in range(len(keys))] + (["value"] if value is not None else [])
    slim = df.select(*columns, (weight if weight is not None else F.lit(1).cast("bigint")).alias("weight"))
    return slim.groupBy(*names).agg(F.sum("weight").alias("weight"))


def heavy_keys(df: DataFrame, fields: Sequence[str], percent: int) -> DataFrame:
    """(field, key_value, n_rows) of the non-null values that hold at least ``percent`` % of all rows of ``df``.

    One pass for all fields: rows are compressed to the combinations of the fields, from which each field's totals and
    the number of all rows follow.
    """
    weights = compress(df, fields)
    total = weights.agg(F.sum("weight").alias("total"))
    each = F.explode(
        F.array(
            *(
                F.struct(F.lit(field).alias("field"), ref(f"k{i}").cast("string").alias("key_value"))
                for i, field in enumerate(fields)
            )
        )
    )
    totals = (
        weights.select(each.alias("at"), "weight")
        .where("at.key_value is not null")
        .groupBy("at.field", "at.key_value")
        .agg(F.sum("weight").alias("n_rows"))
    )
    return totals.where(F.col("n_rows") * 100 >= total.scalar() * percent)


def measures(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key: key, n_rows, n_values (rows with a value), n_distinct, mode, mode_rows.

    ``mode`` is the commonest non-null value, the smallest of equally common ones; null for a key without values.
    """
    weights = compress(df, [key], value)
    has = F.col("value").isNotNull()
    best = F.min(F.when(has, F.struct((-F.col("weight")).alias("down"), F.col("value").alias("value"))))
    out = weights.groupBy("k0").agg(
        F.sum("weight").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("weight"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        best.alias("best"),
    )
    return out.select(
        F.col("k0").alias("key"),
        "n_rows",
        "n_values",
        "n_distinct",
        F.col("best.value").alias("mode"),
        (-F.col("best.down")).alias("mode_rows"),
    )


def _coarse(value: Column) -> Column:
    """A nondecreasing integer function of a finite or infinite double, fine near 0 too."""
    size = (F.least(F.log2(F.abs(value)), F.lit(1025.0)) + 1075) * COARSE_PER_OCTAVE
    return F.when(value == 0, 0).otherwise(F.floor(F.when(value < 0, -size).otherwise(size))).cast("int")


def _fine(value: Column, low: Column, high: Column) -> Column:
    """A nondecreasing function of ``value`` in [low, high] with at most FINE_BINS + 1 results."""
    width = high / 2 - low / 2
    share = (value / 2 - low / 2) / F.when(width > 0, width)
    return F.coalesce(F.floor(F.when(~F.isnan(share), share) * FINE_BINS), F.lit(0)).cast("int")


def _ranks(cells: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """Adds ``below``: the weight of the cells before, of those with the same keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("below", F.coalesce(F.sum(weight).over(w), F.lit(0)))


def percentiles(df: DataFrame, key: str, value: str, permille: Sequence[int]) -> DataFrame:
    """(key, permille, n, value): the exact percentiles of each key's numbers, null and NaN aside.

    The percentile is the smallest value v such that at least ``permille`` / 1000 of the key's numbers are <= v.
    Keys without any number have no row. -0.0 and 0.0 are one value.
    """
    number = df.select(ref(key).alias("key"), (ref(value).cast("double") + F.lit(0.0)).alias("number"))
    number = number.where("number is not null and not isnan(number)")
    weights = compress(number, ["key"], "number").withColumnRenamed("k0", "key")
    weights = weights.withColumn("bucket", _coarse(F.col("value")))

    coarse = weights.groupBy("key", "bucket").agg(
        F.sum("weight").alias("weight"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    coarse = _ranks(coarse, ["key"], "bucket", "weight")
    coarse = coarse.withColumn("n", F.sum("weight").over(Window.partitionBy("key")))
    wanted = F.array(*(F.lit(int(p)).cast("int") for p in permille))
    rank = lambda p: F.greatest(F.lit(1), F.floor((F.col("n") * p + 999) / F.lit(1000))).cast("bigint")
    inside = F.filter(wanted, lambda p: (rank(p) > F.col("below")) & (rank(p) <= F.col("below") + F.col("weight")))
    targets = coarse.select("key", "bucket", "low", "high", "n", "below", F.explode(inside).alias("permille"))
    targets = targets.withColumn("rank", rank(F.col("permille")) - F.col("below")).drop("below")

    t, w = targets.alias("t"), weights.alias("w")
    near = w.join(t, F.col("w.key").eqNullSafe(F.col("t.key")) & (F.col("w.bucket") == F.col("t.bucket"))).select(
        "t.key", "t.permille", "t.n", "t.rank", "w.value", "w.weight", _fine(F.col("w.value"), F.col("t.low"), F.col("t.high")).alias("bin")
    )
    for _ in range(ROUNDS):
        near = _refined(near)
    running = Window.partitionBy("key", "permille").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = near.withColumn("upto", F.sum("weight").over(running))
    return last.where("upto >= rank").groupBy("key", "permille", "n").agg(F.min("value").alias("value"))


def _refined(near: DataFrame) -> DataFrame:
    """The rows of the bin that holds the rank, of each key and permille, with the rank inside it and finer bins."""
    cell = ["key", "permille", "n", "rank"]
    bins = near.groupBy(*cell, "bin").agg(F.sum("weight").alias("bin_weight"), F.min("value").alias("low"), F.max("value").alias("high"))
    bins = _ranks(bins, cell, "bin", "bin_weight").where("rank > below and rank <= below + bin_weight")
    a, b = near.alias("a"), bins.alias("b")
    same = F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.permille") == F.col("b.permille")) & (F.col("a.bin") == F.col("b.bin"))
    finer = _fine(F.col("a.value"), F.col("b.low"), F.col("b.high"))
    return a.join(b, same).select("a.key", "a.permille", "a.n", (F.col("a.rank") - F.col("b.below")).alias("rank"), "a.value", "a.weight", finer.alias("bin"))

"""Counts of values: exact maps, saturating buckets, top-k, frequency sketches, histograms and quantiles.

All start with an aggregation that combines on the map side. Ranks inside a key are taken over its distinct values with
their counts, after each task has cut them to the first k (Spark pushes the limit of a rank below the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_map(df: DataFrame, key: Column, by: Column) -> DataFrame:
    """(key, total): the sum of the increments of each non-null key."""
    return df.select(key.alias("key"), by.alias("by")).where("key is not null").groupBy("key").agg(F.sum("by").alias("total"))


def saturating_buckets(df: DataFrame, bucket: Column, by: Column, n: int, width: int) -> DataFrame:
    """(bucket, value): counters 0 to n - 1 of ``width`` bits (at most 8), which stop at their maximum. Counters that
    nothing raised have no row; increments outside 0 to n - 1 are left out, as are those that are not positive."""
    if not 1 <= width <= 8:
        raise ValueError("the width is 1 to 8 bits")
    rows = df.select(bucket.cast("bigint").alias("bucket"), by.alias("by")).where((F.col("bucket") >= 0) & (F.col("bucket") < n) & (F.col("by") > 0))
    return rows.groupBy("bucket").agg(F.least(F.sum("by"), F.lit((1 << width) - 1)).cast("int").alias("value"))


def buckets_with(buckets: DataFrame, n: int, value: int) -> DataFrame:
    """One row, n_buckets: how many of n counters have the value; those without a row are 0."""
    found = F.count_if(F.col("value") == value)
    return buckets.agg((found if value else F.lit(n) - F.count_if(F.col("value") != 0)).alias("n_buckets"))


def frequencies(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, value, n: how often each non-null value occurs."""
    return df.withColumn("value", value).where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, keys: Sequence[str], value: Column, k: int) -> DataFrame:
    """keys, place, value, n: the k commonest values; the smaller value first of equally common ones."""
    counts = frequencies(df, keys, value)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("n"), F.asc("value"))
    if not keys:  # no window over all values in one task: a distributed top-k first
        counts = counts.orderBy(F.desc("n"), F.asc("value")).limit(k)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select(*keys, "place", "value", "n")


def top_k_approx(df: DataFrame, keys: Sequence[str], value: Column, k: int, tracked: int = 10_000) -> DataFrame:
    """keys, value, n by the built-in sketch of ``tracked`` counters; n may be too high."""
    found = df.withColumn("value", value).groupBy(*keys).agg(F.expr(f"approx_top_k(value, {k}, {tracked})").alias("top"))
    return found.select(*keys, F.explode("top").alias("t")).select(*keys, F.col("t.item").alias("value"), F.col("t.count").alias("n"))


@dataclass(frozen=True)
class CountMin:
    """A table of ``depth`` rows of ``width`` counters. An estimate is never too low, and with probability
    1 - e^-depth too high by at most e / width of all counts."""

    width: int = 1 << 14
    depth: int = 5

    def cells(self, value: Column) -> Column:
        text, w = value.cast("string"), F.lit(self.width).cast("bigint")
        a, b = F.pmod(F.xxhash64(text), w), F.pmod(F.xxhash64(text, F.lit(1)), w)
        return F.transform(F.sequence(F.lit(0), F.lit(self.depth - 1)), lambda i: i * w + F.pmod(a + i * (b * 2 + 1), w))

    def build(self, df: DataFrame, value: Column) -> DataFrame:
        """(cell, n). Values are counted before they are spread over the rows, so a heavy one costs ``depth`` rows a task."""
        counts = frequencies(df.select(value.alias("value")), [], F.col("value"))
        return counts.select(F.explode(self.cells(F.col("value"))).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n"))

    @staticmethod
    def merge(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b).groupBy("cell").agg(F.sum("n").alias("n"))

    def estimate(self, table: DataFrame, values: DataFrame, value: Column) -> DataFrame:
        """(value, n) for the distinct non-null values."""
        asked = values.select(value.alias("value")).where("value is not null").distinct()
        at = asked.select("value", F.explode(self.cells(F.col("value"))).alias("cell"))
        return at.join(table, "cell", "left").groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def histogram(df: DataFrame, keys: Sequence[str], value: Column, low: float, width: float, bins: int) -> DataFrame:
    """keys, bin, n of bins [low + i width, low + (i + 1) width); -1 is below them, ``bins`` above. Null and NaN do not
    count, empty bins have no row."""
    at = F.floor((value - F.lit(low)) / F.lit(width))
    bin = F.when(at < 0, -1).when(at >= bins, bins).otherwise(at).cast("int")
    return df.where(value.isNotNull() & ~F.isnan(value)).select(*keys, bin.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def quantiles_approx(df: DataFrame, keys: Sequence[str], value: Column, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """keys, quantiles: an array in the order of ``shares``, by the built-in summary."""
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*keys).agg(F.percentile_approx(value, list(shares), accuracy).alias("quantiles"))

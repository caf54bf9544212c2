"""Aggregate expressions for checking estimates and summarising numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_and_variance(x: Column) -> Column:
    """struct(n, mean, variance) with the population variance; mean null for no values, variance null for fewer than two."""
    n = F.count(x)
    return F.struct(n.alias("n"), F.avg(x.cast("double")).alias("mean"), F.when(n > 1, F.var_pop(x.cast("double"))).alias("variance"))


def error_of_estimate(value: Column, expected: Column) -> Column:
    """The standard error of estimate: sqrt(sum((v - e)^2) / (n - 2)) over pairs without null; null for n <= 2."""
    gap = value.cast("double") - expected.cast("double")
    n = F.count(gap)
    return F.when(n > 2, F.sqrt(F.sum(gap * gap) / (n - 2)))

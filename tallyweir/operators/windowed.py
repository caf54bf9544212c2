"""Measures over stretches of event time: equal buckets, a fixed interval, and a look back from a given now.

Counts filter or group directly. Distinct counts over a stretch come from a sketch per bucket: buckets are sketched once
and any run of them is united, so a look back that moves on needs no old rows. ``now`` is always a parameter.
Times are TIMESTAMP_NTZ or TIMESTAMP columns; rows without a time, or without a key, are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.columns import floor_to, from_micros, micros, ref


def _rows(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    df = df.where(ref(time).isNotNull())
    for k in keys:
        df = df.where(ref(k).isNotNull())
    return df


def _us(moment: datetime) -> Column:
    """Microseconds of a naive datetime that means UTC."""
    delta = moment - datetime(1970, 1, 1)
    return F.lit((delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds)


def bucketed(df: DataFrame, keys: Sequence[str], time: str, width: int, measures: dict[str, Column]) -> DataFrame:
    """keys, bucket_start and the measures of each bucket of ``width`` microseconds from 1970-01-01 on."""
    start = from_micros(floor_to(micros(ref(time)), width)).alias("bucket_start")
    return _rows(df, keys, time).groupBy(*keys, start).agg(*(c.alias(n) for n, c in measures.items()))


def windowed(df: DataFrame, keys: Sequence[str], time: str, after: datetime, before: datetime, measures: dict[str, Column]) -> DataFrame:
    """keys and the measures of the rows strictly between two moments. The bounds stand beside the bare column, so they reach
    the scan."""
    rows = _rows(df, keys, time).where((ref(time) > _literal(df, time, after)) & (ref(time) < _literal(df, time, before)))
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


def lookback(df: DataFrame, keys: Sequence[str], time: str, now: datetime, back: int, measures: dict[str, Column]) -> DataFrame:
    """keys and the measures of the rows of the last ``back`` microseconds: (now - back, now]."""
    start, end = _literal(df, time, now - timedelta(microseconds=back)), _literal(df, time, now)
    rows = _rows(df, keys, time).where((ref(time) > start) & (ref(time) <= end))
    return rows.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


def _literal(df: DataFrame, time: str, moment: datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast(df.schema[time].dataType)


def bucket_sketches(df: DataFrame, keys: Sequence[str], time: str, width: int, value: Column, precision: int = 12) -> DataFrame:
    """keys, bucket_us and a mergeable sketch of the distinct values of each bucket ('' is a value)."""
    rows = _rows(df, keys, time).where(value.isNotNull())
    bucket = floor_to(micros(ref(time)), width).alias("bucket_us")
    return rows.groupBy(*keys, bucket).agg(F.hll_sketch_agg(F.concat(F.lit("="), value.cast("string")), F.lit(precision)).alias("sketch"))


def uniques_between(sketches: DataFrame, keys: Sequence[str], width: int, after: datetime, before: datetime) -> DataFrame:
    """keys, uniques: the distinct values in the buckets that lie wholly in [after, before]."""
    inside = sketches.where((F.col("bucket_us") >= _us(after)) & (F.col("bucket_us") + F.lit(width) <= _us(before)))
    return inside.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("uniques"))

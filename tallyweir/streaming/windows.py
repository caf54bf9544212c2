"""Windowed aggregations of streams with Spark's own watermark.

The watermark is the greatest event time seen less the delay. Where lateness is judged by the time of receipt, and
windows are to be corrected until a cut-off, use ``streaming.panes``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.columns import ref


def with_watermark(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Event times without a zone become TIMESTAMP, which watermarks need (the session's zone is to be UTC)."""
    return stream.withColumn(time, ref(time).cast("timestamp")).withWatermark(time, delay)


def _measured(grouped, measures: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    out = grouped.agg(*(c.alias(n) for n, c in measures.items()))
    return out.select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *measures)


def tumbling(stream: DataFrame, keys: Sequence[str], time: str, size: str, delay: str, measures: dict[str, Column]) -> DataFrame:
    return _measured(with_watermark(stream, time, delay).groupBy(*keys, F.window(time, size).alias("window")), measures, keys)


def sliding(stream: DataFrame, keys: Sequence[str], time: str, size: str, slide: str, delay: str, measures: dict[str, Column]) -> DataFrame:
    return _measured(with_watermark(stream, time, delay).groupBy(*keys, F.window(time, size, slide).alias("window")), measures, keys)


def sessions(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str, measures: dict[str, Column]) -> DataFrame:
    return _measured(with_watermark(stream, time, delay).groupBy(*keys, F.session_window(time, gap).alias("window")), measures, keys)

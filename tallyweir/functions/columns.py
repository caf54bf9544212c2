"""Small helpers on column names and times."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ref(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without_clash(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """``df`` with each column that an operator is about to add renamed ``<name>_in`` (again until it is free).

    Spark compares names without case, so the comparison here does too.
    """
    taken = {c.lower() for c in df.columns} | {c.lower() for c in reserved}
    wanted = {c.lower() for c in reserved}
    for name in df.columns:
        if name.lower() in wanted:
            new = f"{name}_in"
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
            df = df.withColumnRenamed(name, new)
    return df


def _in_utc() -> bool:
    """Whether the session's zone is UTC, so that conversions by zone change nothing."""
    return SparkSession.active().conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def micros(time: Column) -> Column:
    """Microseconds since 1970-01-01 UTC of a TIMESTAMP_NTZ that means UTC, whatever the session's zone."""
    if _in_utc():
        return F.unix_micros(time.cast("timestamp"))
    # by fields, which do not depend on a zone; a conversion by zone would move times that the zone skips
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    rest = (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")
    return F.unix_date(time.cast("date")) * F.lit(86_400_000_000) + seconds * F.lit(1_000_000).cast("bigint") + rest


def from_micros(value: Column) -> Column:
    """The TIMESTAMP_NTZ of microseconds since 1970-01-01, meaning UTC."""
    if _in_utc():
        return F.timestamp_micros(value).cast("timestamp_ntz")
    none = F.lit(0)
    seconds = (value.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, seconds)


def floor_to(value: Column, width: int) -> Column:
    """``value`` rounded down to a multiple of ``width``, for negative numbers too (all integers)."""
    return value - F.pmod(value, F.lit(width).cast("bigint"))

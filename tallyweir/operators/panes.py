"""Event-time aggregates corrected by late rows: stream slicing.

Time is cut into non-overlapping *panes*, as long as the greatest common divisor of the window's size and slide, so a
window is a whole number of panes. A row goes to one pane, whatever the number of windows that cover it. For each pane
the partial aggregates are kept by *arrival slice*: slices are as long as a pane and begin at the cut-off instants of
the windows, so that a slice lies wholly before or wholly after any cut-off. Then

* the final value of a window is the merge of its panes' slices before the window's cut-off,
* a late row changes one pane, and only the windows over that pane are recomposed,
* a row is *closed* when the last window that covers it had reached its cut-off when the row was received. With
  tumbling windows that is: received at or after the window's end plus the allowed lateness.

Rows are reduced to (keys, pane, slice) before anything is shuffled; a heavy key or a heavy day costs each task one row
per pane and slice. Everything is built-in expressions.

Rows in which either time is null belong to no window and are no late rows: ``verdict`` is 'untimed'. Rows that are
ahead of the receiver's clock are in time. Rows sent again count again. A null key is a key of its own. An empty table
gives empty results. Columns of the input called like an added one are renamed ``<name>_in``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweir.functions.columns import floor_to, from_micros, micros, ref, without_clash

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR
ADDED = ("pane_us", "slice_us", "verdict")


@dataclass(frozen=True)
class Windows:
    """Windows of ``size`` that begin every ``slide``, from 1970-01-01 UTC on, open for ``lateness`` after their end
    (all in microseconds)."""

    size: int = DAY
    slide: int = DAY
    lateness: int = 48 * HOUR

    def __post_init__(self) -> None:
        if self.size <= 0 or self.slide <= 0 or self.lateness < 0 or self.slide > self.size:
            raise ValueError("need 0 < slide <= size and lateness >= 0")

    @property
    def pane(self) -> int:
        return gcd(self.size, self.slide)

    def slice_of(self, arrival: Column) -> Column:
        """The start of the arrival slice; cut-off instants are starts of slices."""
        shift = self.lateness % self.pane
        return floor_to(arrival - F.lit(shift), self.pane) + F.lit(shift)

    def cut_off(self, window: Column) -> Column:
        """The instant from which rows no longer count, of the window that begins there."""
        return window + F.lit(self.size + self.lateness)

    def last_end(self, pane: Column) -> Column:
        """The end of the last window over the pane."""
        return floor_to(pane, self.slide) + F.lit(self.size)

    def starts(self, pane: Column) -> Column:
        """The starts of all windows over the pane, as an array."""
        last = floor_to(pane, self.slide)
        first = floor_to(pane - F.lit(self.size), self.slide) + F.lit(self.slide)
        return F.sequence(first, last, F.lit(self.slide).cast("bigint"))


def sort_out(df: DataFrame, windows: Windows, event: str = "data_time", arrival: str = "receive_time") -> DataFrame:
    """``df`` with pane_us and slice_us (bigint) and verdict: 'in_time', 'closed' or 'untimed'."""
    df = without_clash(df, ADDED)
    renamed = {c.lower(): f"{c}_in" for c in ADDED}
    event, arrival = (c if c in df.columns else renamed.get(c.lower(), c) for c in (event, arrival))
    at, got = micros(ref(event)), micros(ref(arrival))
    pane = floor_to(at, windows.pane)
    closed = got >= windows.last_end(pane) + F.lit(windows.lateness)
    return df.withColumns(
        {
            "pane_us": pane,
            "slice_us": windows.slice_of(got),
            "verdict": F.when(at.isNull() | got.isNull(), "untimed").when(closed, "closed").otherwise("in_time"),
        }
    )


def number_partials(field: str) -> dict[str, tuple[Column, str]]:
    """Partial aggregates of a numeric field and how two of them merge. NaN and null do not count as numbers.

    Values that six decimal places say exactly, and that are below 10**12, are summed as decimals (``sum_exact``), so
    their sum is the same for any order of rows. All others are summed as doubles (``sum_rest``) and counted
    (``n_inexact``): nothing is left out of a sum. ``with_sums`` puts the two together.
    """
    value = F.when(~F.isnan(ref(field)), ref(field).cast("double"))
    decimal = value.try_cast("decimal(18,6)")
    exact = F.coalesce(decimal.cast("double") == value, F.lit(False))
    return {
        "n_rows": (F.count(F.lit(1)), "sum"),
        "n_values": (F.count(value), "sum"),
        "sum_exact": (F.sum(F.when(exact, decimal).cast("decimal(38,6)")), "sum"),
        "sum_rest": (F.sum(F.when(~exact, value)), "sum"),
        "n_inexact": (F.count(F.when(~exact, value)), "sum"),
        "min_value": (F.min(value), "min"),
        "max_value": (F.max(value), "max"),
    }


def with_sums(df: DataFrame) -> DataFrame:
    """``df`` with ``sum_value`` (double; null if there was no value) in the place of sum_exact and sum_rest."""
    zero = F.lit(0.0)
    total = F.coalesce(F.col("sum_exact").cast("double"), zero) + F.coalesce(F.col("sum_rest"), zero)
    total = F.when(F.col("n_values") > 0, total).alias("sum_value")
    return df.select(*(total if c == "sum_exact" else ref(c) for c in df.columns if c != "sum_rest"))


def _merged(name: str, how: str) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max}[how](ref(name)).alias(name)


def pane_table(df: DataFrame, windows: Windows, keys: Sequence[str], partials: dict[str, tuple[Column, str]], event: str = "data_time", arrival: str = "receive_time") -> DataFrame:
    """keys, pane_us, slice_us and the partial aggregates: the mergeable state of the operator. Rows that came when all
    their windows were closed are left out (``sort_out`` sets them apart), as are untimed rows.

    Tables of separate portions may be united and merged again by ``merge_panes``.
    """
    placed = sort_out(df, windows, event, arrival).where("verdict = 'in_time'")
    return placed.groupBy(*keys, "pane_us", "slice_us").agg(*(c.alias(n) for n, (c, _) in partials.items()))


def merge_panes(panes: DataFrame, keys: Sequence[str], partials: dict[str, tuple[Column, str]]) -> DataFrame:
    return panes.groupBy(*keys, "pane_us", "slice_us").agg(*(_merged(n, how) for n, (_, how) in partials.items()))


def over_windows(panes: DataFrame, windows: Windows) -> DataFrame:
    """A row (with ``window_us``) for each pane, slice and window that covers the pane and was open in the slice."""
    spread = panes.withColumn("window_us", F.explode(windows.starts(F.col("pane_us"))))
    return spread.where(F.col("slice_us") < windows.cut_off(F.col("window_us")))


def composed(parts: DataFrame, windows: Windows, keys: Sequence[str], partials: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, window_start, window_end and the merged partial aggregates of rows with ``window_us``."""
    out = parts.groupBy(*keys, "window_us").agg(*(_merged(n, how) for n, (_, how) in partials.items()))
    return out.select(
        *keys,
        from_micros(F.col("window_us")).alias("window_start"),
        from_micros(F.col("window_us") + F.lit(windows.size)).alias("window_end"),
        *partials,
    )


def final_windows(panes: DataFrame, windows: Windows, keys: Sequence[str], partials: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, window_start, window_end and the aggregates of each window when it is closed."""
    return composed(over_windows(panes, windows), windows, keys, partials)


def revisions(panes: DataFrame, windows: Windows, keys: Sequence[str], partials: dict[str, tuple[Column, str]]) -> DataFrame:
    """keys, window_start, revision (from 1), emitted_at and the aggregates as known then: a row each time that rows
    received in one slice changed the window. ``emitted_at`` is the slice's end. A window has at most
    (size + lateness) / pane slices plus those before its start, so each group of the window function is small."""
    deltas = over_windows(panes, windows).groupBy(*keys, "window_us", "slice_us").agg(*(_merged(n, how) for n, (_, how) in partials.items()))
    order = Window.partitionBy(*keys, "window_us").orderBy("slice_us")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    running = {"sum": F.sum, "min": F.min, "max": F.max}
    out = deltas.select(
        *keys,
        "window_us",
        F.row_number().over(order).alias("revision"),
        from_micros(F.col("slice_us") + F.lit(windows.pane)).alias("emitted_at"),
        *(running[how](n).over(so_far).alias(n) for n, (_, how) in partials.items()),
    )
    return out.select(*keys, from_micros(F.col("window_us")).alias("window_start"), "revision", "emitted_at", *partials)


def closed_rows(df: DataFrame, windows: Windows, event: str = "data_time", arrival: str = "receive_time") -> DataFrame:
    """The rows that came after the last of their windows was closed, with all their columns."""
    return sort_out(df, windows, event, arrival).where("verdict = 'closed'").drop(*ADDED)

"""Measures by the state they need: partial aggregates of rows, how states merge, and the result from a state.

Measures of one field share their parts: sum, mean and var need n, sum and m2 (the sum of squared deviations), each of
which is kept once. States of separate batches merge to the state of their union; m2 merges by the deviations of the
parts' means, which does not cancel as raw second moments do. All of it is built-in expressions.

``register`` adds a measure of one's own, with parts of its own if it needs them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """``partial``: the aggregate over rows' values (and the precision asked for). ``merge``: the aggregate over a
    column of states; None for m2, which needs the means too."""

    partial: Callable[[Column, int], Column]
    merge: Callable[[Column], Column] | None


@dataclass(frozen=True)
class Measure:
    """``input``: 'any' (the value as it is), 'number' or 'text'. ``finish`` gets the state's columns by part. ``size``: bytes of a key's
    state for a precision, apart from what is shared (see ``Rollup.bytes_per_key``)."""

    name: str
    input: str
    parts: tuple[str, ...]
    finish: Callable[[Callable[[str], Column]], Column]
    size: Callable[[int], int] = lambda p: 8
    shares_moments: bool = False


def _text(x: Column) -> Column:
    # sketches leave out empty strings, which are values here
    return F.concat(F.lit("="), x)


PARTS: dict[str, Part] = {
    "present": Part(lambda x, p: F.count(x), F.sum),
    "n": Part(lambda x, p: F.count(x), F.sum),
    "sum": Part(lambda x, p: F.sum(x), F.sum),
    "m2": Part(lambda x, p: F.var_pop(x.cast("double")) * F.count(x), None),
    "max": Part(lambda x, p: F.max(x), F.max),
    "min": Part(lambda x, p: F.min(x), F.min),
    "hll": Part(lambda x, p: F.hll_sketch_agg(_text(x), F.lit(p)), F.hll_union_agg),
}

MEASURES: dict[str, Measure] = {}


def register(measure: Measure, parts: dict[str, Part] | None = None) -> None:
    for name, part in (parts or {}).items():
        if PARTS.setdefault(name, part) is not part:
            raise ValueError(f"there is a part {name} already")
    missing = [p for p in measure.parts if p not in PARTS]
    if missing or measure.name in MEASURES:
        raise ValueError(f"measure {measure.name} is there already or needs unknown parts {missing}")
    MEASURES[measure.name] = measure


register(Measure("count", "any", ("present",), lambda c: c("present")))
register(Measure("sum", "number", ("sum",), lambda c: c("sum").cast("double"), shares_moments=True))
register(Measure("mean", "number", ("n", "sum"), lambda c: F.try_divide(c("sum").cast("double"), c("n")), shares_moments=True))
register(Measure("var", "number", ("n", "sum", "m2"), lambda c: F.when(c("n") > 1, c("m2") / (c("n") - 1)), shares_moments=True))
register(Measure("max", "number", ("max",), lambda c: c("max").cast("double")))
register(Measure("min", "number", ("min",), lambda c: c("min").cast("double")))
register(
    Measure("uniquecount", "text", ("hll",), lambda c: F.coalesce(F.hll_sketch_estimate(c("hll")), F.lit(0)), lambda p: 12 + (6 * 2**p + 7) // 8)
)

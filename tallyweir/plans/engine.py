"""Named rollups over a source, and queries on them.

An ``Engine`` holds rollup definitions and where each one's results come from: computed from a DataFrame when asked
(the filter on keys moves below the aggregation and into the scan), or a table of results or states that a stream keeps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.functions.columns import ref
from tallyweir.plans import collate as c
from tallyweir.plans.dialect import Query, parse
from tallyweir.plans.spec import MeasureSpec, Rollup, SpecError

if TYPE_CHECKING:
    from tallyweir.streaming.rollup import RollupTable


class UnknownRollup(SpecError):
    """No rollup has this name."""


@dataclass(frozen=True)
class _Entry:
    rollup: Rollup
    results: Callable[[], DataFrame]


class Engine:
    """``strict``: unknown measures and criteria on fields that are no keys are errors; otherwise they are left out."""

    def __init__(self, strict: bool = True) -> None:
        self.strict = strict
        self._entries: dict[str, _Entry] = {}

    def create(self, rollup: Rollup, results: DataFrame | Callable[[], DataFrame]) -> None:
        """Adds a rollup over a table of its results (keys and measures), or a function that reads it afresh. The
        first definition of a name stands."""
        self._entries.setdefault(rollup.name, _Entry(rollup, results if callable(results) else lambda: results))

    def create_from(self, rollup: Rollup, rows: DataFrame) -> None:
        """Adds a rollup that is computed from rows whenever it is asked."""
        self.create(rollup, c.collate(rows, rollup))

    def create_kept(self, table: RollupTable) -> None:
        """Adds a rollup whose states a stream or batches keep; each question merges the states of its keys as they are
        then, and reads no rows."""
        self.create(table.rollup, table.read)

    def drop(self, name: str) -> None:
        self._entries.pop(name, None)

    def names(self) -> list[str]:
        return list(self._entries)

    def rollup(self, name: str) -> Rollup:
        if name not in self._entries:
            raise UnknownRollup(name)
        return self._entries[name].rollup

    def table(self, name: str) -> DataFrame:
        self.rollup(name)
        return self._entries[name].results()

    def query(self, name: str, text: str | Query, partial_keys: bool = False) -> DataFrame:
        """One row with a column for each measure asked for, in their order; no row if the key is not there or some key
        has no criterion (with ``partial_keys``: a row for each key that fits, keys included)."""
        query = parse(text, self.strict) if isinstance(text, str) else text
        rollup = self.rollup(name)
        wanted = self._measures(rollup, query)
        other = [f for f, _ in query.criteria if f not in rollup.keys]
        if other and self.strict:
            raise SpecError(f"{', '.join(other)} is no key of {name}; its keys are {', '.join(rollup.keys)}")
        rows = self.table(name)
        missing = [k for k in rollup.keys if query.value_of(k) is None]
        if missing and not partial_keys:
            rows = rows.where(F.lit(False))
        for key in rollup.keys:
            if (value := query.value_of(key)) is not None:
                kind = rows.schema[key].dataType.simpleString()
                rows = rows.where(ref(key) == F.lit(value).try_cast(kind))
        keys = [ref(k) for k in rollup.keys] if partial_keys else []
        return rows.select(*keys, *(ref(m.column) for m in dict.fromkeys(wanted)))

    def _measures(self, rollup: Rollup, query: Query) -> list[MeasureSpec]:
        found = [(rollup.find(m, f), f"{m}({f})") for m, f in query.measures]
        unknown = [text for spec, text in found if spec is None]
        if unknown and self.strict:
            raise SpecError(f"rollup {rollup.name} has no {', '.join(unknown)}")
        return [spec for spec, _ in found if spec is not None]

    def answer(self, name: str, text: str) -> str:
        """The query's answer as text: the criteria as ``field=value``, then ``measure(field)=value``, a line each."""
        query = parse(text, self.strict)
        wanted = list(dict.fromkeys(self._measures(self.rollup(name), query)))
        rows = self.query(name, query).take(1)
        lines = [f"{f}={v}" for f, v in query.criteria]
        if rows:
            lines += [f"{m.text}={shown(rows[0][m.column], m.name)}" for m in wanted]
        return "\n".join(lines) + "\n"


def shown(value: float | int | None, measure: str = "") -> str:
    """A number as short as it goes: 9078, not 9078.0; exponents from 1e21 on and below 1e-4. A variance of fewer than
    two values shows as NaN, other missing results as 0."""
    if value is None:
        return "NaN" if measure == "var" else "0"
    if isinstance(value, int):
        return str(value)
    if value != value:
        return "NaN"
    if value in (float("inf"), float("-inf")):
        return "+Inf" if value > 0 else "-Inf"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    text = repr(value)
    if "e" in text:
        digits, _, exponent = text.partition("e")
        return f"{digits.removesuffix('.0')}e{int(exponent):+03d}"
    return text

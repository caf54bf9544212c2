"""Rollup definitions: what is grouped by what, and which measures are kept."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from tallyweir.plans.measures import MEASURES, Measure

ROWS = "*"


class SpecError(ValueError):
    """A definition or query that makes no sense."""


@dataclass(frozen=True)
class MeasureSpec:
    """A measure of a field; ``*`` is the row itself and has only ``count``. ``precision`` is for uniquecount."""

    name: str
    field: str = ROWS
    precision: int = 12

    def __post_init__(self) -> None:
        if self.name not in MEASURES:
            raise SpecError(f"no measure {self.name}; there are {', '.join(MEASURES)}")
        if self.field == ROWS and self.name != "count":
            raise SpecError(f"{self.name} needs a field")
        if self.name == "uniquecount" and not 4 <= self.precision <= 18:
            raise SpecError("the precision of uniquecount is 4 to 18")

    @property
    def measure(self) -> Measure:
        return MEASURES[self.name]

    @property
    def column(self) -> str:
        """The result's column: count, sum_height, ..."""
        return self.name if self.field == ROWS else f"{self.name}_{self.field}"

    @property
    def text(self) -> str:
        return f"{self.name}({self.field})"


@dataclass(frozen=True)
class Rollup:
    """Rows are grouped by ``keys`` (none: one group of all rows) after ``where``; a row that lacks a key is left out."""

    name: str
    keys: tuple[str, ...] = ()
    measures: tuple[MeasureSpec, ...] = ()
    where: Column | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        if not self.measures:
            raise SpecError(f"rollup {self.name} has no measures")
        if len(set(self.keys)) < len(self.keys):
            raise SpecError(f"rollup {self.name} names a key twice")
        named = [(m.name, m.field) for m in self.measures]
        if len(set(named)) < len(named):
            raise SpecError(f"rollup {self.name} names a measure twice")

    @property
    def fields(self) -> list[str]:
        """The measured fields, each once."""
        return list(dict.fromkeys(m.field for m in self.measures if m.field != ROWS))

    def find(self, name: str, field: str) -> MeasureSpec | None:
        return next((m for m in self.measures if (m.name, m.field) == (name, field)), None)

    def bytes_per_key(self) -> int:
        """An estimate of the state of one key: counts, sums and extremes as 8 bytes each, what sum, mean and var of a
        field share as 32, and sketches by their precision."""
        shared = {m.field for m in self.measures if m.measure.shares_moments}
        alone = [m for m in self.measures if not m.measure.shares_moments]
        return 32 * len(shared) + sum(m.measure.size(m.precision) for m in alone)

    def bytes_for(self, n_keys: int) -> int:
        return n_keys * self.bytes_per_key()

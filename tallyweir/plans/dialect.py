"""The query dialect: ``select measure(field), ... where key='value' and ...``.

Keywords are read in any case, names exactly. ``where`` is required. A measure is ``name(field)`` or ``count(*)``;
criteria are ``field='value'``, joined by ``and`` or commas, with a value of at least one character and no quote in it.
A field that is given twice keeps its first value. Anything else is an error, unless ``strict`` is off: then what is not
understood is passed over, connectives between criteria included.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from tallyweir.plans.spec import SpecError


class QueryError(SpecError):
    """The text is no query."""


@dataclass(frozen=True)
class Query:
    measures: tuple[tuple[str, str], ...]
    criteria: tuple[tuple[str, str], ...]

    def value_of(self, key: str) -> str | None:
        return next((v for f, v in self.criteria if f == key), None)


_NAME = r"[^\s,()='\"]+"
_SHAPE = re.compile(r"\s*select\s+(.+?)\s+where\s+(.+?)\s*", re.IGNORECASE | re.DOTALL)
_MEASURE = re.compile(rf"({_NAME})\(({_NAME})\)")
_CRITERION = re.compile(rf"({_NAME})='([^']+)'")
_AND = re.compile(r"\s*,\s*|\s+and\s+", re.IGNORECASE)


def _list(text: str, item: re.Pattern, between: re.Pattern, what: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while True:
        found = item.match(text, at)
        if not found:
            raise QueryError(f"no {what} at: {text[at:] or 'the end'}")
        out.append(found.groups())
        at = found.end()
        if at == len(text):
            return out
        gap = between.match(text, at)
        if not gap:
            raise QueryError(f"not understood after a {what}: {text[at:]}")
        at = gap.end()


def parse(text: str, strict: bool = True) -> Query:
    shape = _SHAPE.fullmatch(text)
    if not shape:
        raise QueryError("a query is: select measure(field), ... where field='value' and ...")
    if strict:
        measures = _list(shape[1], _MEASURE, re.compile(r"\s*,\s*"), "measure")
        criteria = _list(shape[2], _CRITERION, _AND, "criterion")
    else:
        measures, criteria = _MEASURE.findall(shape[1]), _CRITERION.findall(shape[2])
    return Query(tuple(measures), tuple(criteria))

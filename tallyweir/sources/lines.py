"""Posted text lines to typed rows, with the reason for each line that does not parse.

Two layouts: ``csv`` (time and five values, comma separated) and ``obs`` (time, then ``field=value`` separated by the
character that follows the time). Valid lines are the common case, so they take a columnar path: lines are put in
blocks of one layout and delimiter, and a block is parsed in one go, by Arrow's CSV reader where no quotes or line
breaks occur in it and by one regular expression over the block otherwise. Both accept a block only if all of its lines
are valid, in which case the columns they give are right; otherwise the block is parted in two, and its parts again,
until the bad lines are alone: where the reader can tell which lines it stumbled over, into these and the others, which
is one further call however many lines are bad, and else in the middle. The lines stumbled over are diagnosed by
``strict``, a character-by-character reader of the format, whose word is final: a line that the columnar path cannot
take but ``strict`` can is loaded. Nothing sorts the lines by their looks beforehand; only those without any delimiter
after leading digits belong to no block and are diagnosed at once.

The work is done batch by batch in the tasks that read the lines. Nothing is shuffled, and memory is bounded by the
Arrow batch, so neither skewed postings nor runs of bad lines matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.columns import from_micros, ref, without_clash

FIELDS = ("name", "country", "iata", "height", "tz")
#: 2000-01-01 and 2100-01-01 UTC in microseconds: times lie in between.
FIRST_US, END_US = 946_684_800_000_000, 4_102_444_800_000_000
NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
REASONS = ("time", "quoting", "columns", "height")
#: Blocks this small go to ``strict`` whole: one call of the columnar path costs as much as reading so many lines.
LEAF = 32

_DIGITS = re.compile("[0-9]+")
_NUMBER = re.compile(NUMBER)
_FIELDS = pa.array(FIELDS)
_PARSED = pa.schema([("data_time_us", pa.int64()), *((f, pa.float64() if f == "height" else pa.string()) for f in FIELDS)])


def strict(line: str | None, layout: str | None) -> tuple[str | None, tuple | None]:
    """(reason, None) or (None, (time in microseconds, name, country, iata, height, tz)) of one line.

    A null line has no time. Any layout but 'csv' is read as 'obs'. A line of the ``obs`` layout whose delimiter is
    itself ``"`` fails by its quoting.
    """
    text = (line or "").removesuffix("\r")
    csv = layout == "csv"
    digits = _DIGITS.match(text)
    if not digits or len(digits[0].lstrip("0")) > 16 or not FIRST_US <= int(digits[0]) < END_US:
        return "time", None
    at, size = digits.end(), len(text)
    if csv and at < size and text[at] != ",":
        return "time", None
    fields: list[tuple[str, str]] = []
    mark = text[at : at + 1]
    if mark == '"':
        return "quoting", None
    while at < size:
        at += 1  # past the delimiter
        name = ""
        if not csv:
            start = at
            while at < size and text[at] not in ("=", mark, '"'):
                at += 1
            name = text[start:at]
            if at < size and text[at] == '"':
                return "quoting", None
            if at == size or text[at] == mark:
                fields.append((name, ""))
                continue
            at += 1  # past the =
        if at < size and text[at] == '"':
            parts = []
            while True:
                end = text.find('"', at + 1)
                if end < 0:
                    return "quoting", None
                parts.append(text[at + 1 : end])
                at = end + 1
                if text[at : at + 1] != '"':
                    break
            if at < size and text[at] != mark:
                return "quoting", None
            fields.append((name, '"'.join(parts)))
        else:
            end = text.find(mark, at)
            end = size if end < 0 else end
            value = text[at:end]
            if '"' in value:
                return "quoting", None
            fields.append((name, value))
            at = end
    if len(fields) != len(FIELDS):
        return "columns", None
    if csv:
        values = dict(zip(FIELDS, (v for _, v in fields)))
    else:
        values = dict(fields)
        if len(values) != len(FIELDS) or any(f not in values for f in FIELDS):
            return "columns", None
    height = None
    if values["height"]:
        if not _NUMBER.fullmatch(values["height"]) or not math.isfinite(height := float(values["height"])):
            return "height", None
    return None, (int(digits[0]), values["name"], values["country"], values["iata"], height, values["tz"])


class _Rejected(Exception):
    """The block holds lines that the columnar path does not take: ``at``, their places where the reader can tell."""

    def __init__(self, at: np.ndarray | None = None) -> None:
        super().__init__()
        self.at = at


def _mask(mask: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Null passes."""
    return pc.fill_null(mask, True).to_numpy(zero_copy_only=False)


def _typed(time: pa.Array, values: dict[str, pa.Array], ok: np.ndarray) -> pa.Table:
    """The typed columns of a block whose times and heights are still text. ``ok``: the lines that have passed so far;
    the block is rejected with all lines that fail any test."""
    ok = ok & _mask(pc.match_substring_regex(time, "^[0-9]{1,18}$"))
    us = pc.if_else(pa.array(ok), time, "0").cast(pa.int64())
    ok &= _mask(pc.and_(pc.greater_equal(us, FIRST_US), pc.less(us, END_US)))
    text = values["height"]
    given = pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)
    ok &= _mask(pc.match_substring_regex(given, f"^{NUMBER}$"))
    if not ok.all():
        given = pc.if_else(pa.array(ok), given, pa.scalar(None, pa.string()))
    height = pc.replace_substring_regex(given, "^[+]", "").cast(pa.float64())
    ok &= _mask(pc.is_finite(height))
    if not ok.all():
        raise _Rejected(np.flatnonzero(~ok))
    return pa.table([us, *(height if f == "height" else values[f] for f in FIELDS)], schema=_PARSED)


def _by_name(names: pa.Array, values: pa.Array, n: int) -> tuple[dict[str, pa.Array], np.ndarray]:
    """The values of the five fields by name (first fields, second fields, ... of all lines are given), and which lines
    have each field once."""
    codes = pc.fill_null(pc.index_in(names, _FIELDS), len(FIELDS)).to_numpy(zero_copy_only=False).reshape(len(FIELDS), n)
    place = np.argsort(codes, axis=0) * n + np.arange(n)
    return {f: values.take(pa.array(place[i])) for i, f in enumerate(FIELDS)}, np.bitwise_or.reduce(1 << codes, axis=0) == (1 << len(FIELDS)) - 1


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _plain(lines: pa.Array, csv: bool, mark: str) -> pa.Table:
    """A block of lines without quotes and line breaks, by the CSV reader."""
    names = ["time", "a", "b", "c", "d", "e"]
    uneven: list[int | None] = []

    def skip(row: pa_csv.InvalidRow) -> str:
        uneven.append(row.number)
        return "skip"

    # one buffer for the reader: the lines with a line break after each
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0].as_buffer()
    table = pa_csv.read_csv(
        pa.BufferReader(joined),
        read_options=pa_csv.ReadOptions(use_threads=False, column_names=names, block_size=max(1024, joined.size + 1)),
        parse_options=pa_csv.ParseOptions(delimiter=mark, quote_char=False, ignore_empty_lines=False, invalid_row_handler=skip),
        convert_options=pa_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False, null_values=[]),
    )
    if None in uneven or table.num_rows + len(uneven) != len(lines):
        raise _Rejected
    bad = np.array(uneven, np.int64) - 1
    try:
        typed = _plain_columns(*(_one(table.column(n)) for n in names), csv=csv) if table.num_rows else None
    except _Rejected as e:
        raise _Rejected(np.union1d(bad, np.delete(np.arange(len(lines)), bad)[e.at])) from e
    if uneven:
        raise _Rejected(bad)
    return typed


def _plain_columns(time: pa.Array, *columns: pa.Array, csv: bool) -> pa.Table:
    ok = np.ones(len(time), bool)
    if csv:
        return _typed(time, dict(zip(FIELDS, columns)), ok)
    fields = pa.concat_arrays(columns)
    split = pc.match_substring(fields, "=")
    if not pc.all(split, min_count=0).as_py():  # a field without = has an empty value
        fields = pc.if_else(split, fields, pc.binary_join_element_wise(fields, "=", ""))
    halves = pc.split_pattern(fields, "=", max_splits=1).flatten()
    even = np.arange(0, 2 * len(fields), 2)
    return _typed(time, *_by_name(halves.take(pa.array(even)), halves.take(pa.array(even + 1)), len(time)))


def _quoted(lines: pa.Array, csv: bool, mark: str) -> pa.Table:
    """A block of lines that may hold quotes and line breaks, by one expression for the whole line."""
    d = _class_of(mark)
    value = f'(?:"(?:[^"]|"")*"|[^"{d}][^"{d}]*|)'
    if csv:
        pattern = "^(?P<time>[0-9]+)" + "".join(f"{d}(?P<v{i}>{value})" for i in range(5)) + "$"
    else:
        pattern = "^(?P<time>[0-9]+)" + "".join(f'{d}(?P<k{i}>[^"={d}]*)(?:=(?P<v{i}>{value}))?' for i in range(5)) + "$"
    found = pc.extract_regex(lines, pattern)
    ok = _mask(pc.is_valid(found))
    time = pc.fill_null(pc.struct_field(found, "time"), "")
    n = len(lines)
    part = lambda name: pc.fill_null(pc.struct_field(found, name), "")
    raw = pa.concat_arrays([part(f"v{i}") for i in range(5)])
    bare = pc.replace_substring(pc.utf8_slice_codeunits(raw, 1, -1), '""', '"')
    values = pc.if_else(pc.starts_with(raw, '"'), bare, raw)
    if csv:
        return _typed(time, {f: values.take(pa.array(np.arange(i * n, (i + 1) * n))) for i, f in enumerate(FIELDS)}, ok)
    named, complete = _by_name(pa.concat_arrays([part(f"k{i}") for i in range(5)]), values, n)
    return _typed(time, named, ok & complete)


def _class_of(mark: str) -> str:
    """The delimiter as it stands in an expression, inside or outside of brackets."""
    return mark if mark.isalnum() or mark.isspace() else "\\" + mark


def _bisect(text: pa.Array, rows: np.ndarray, csv: bool, mark: str, quoted: bool, good: list, odd: list) -> None:
    """Appends (row numbers, columns) of good blocks to ``good`` and the numbers of the lines to be diagnosed to ``odd``.

    A block that fails is parted in two and both parts are taken on: where the reader tells which lines it stumbled over,
    into these and the others, else in the middle. Lines that a reader stumbled over and few lines are diagnosed.

    Blocks are taken, not sliced: some Arrow kernels go wrong on sliced strings.
    """
    while len(rows) > LEAF:
        try:
            good.append((rows, (_quoted if quoted else _plain)(text.take(pa.array(rows)), csv, mark)))
            return
        except _Rejected as e:
            at = e.at
        except pa.ArrowInvalid:
            at = None
        if at is None:
            half = len(rows) // 2
            _bisect(text, rows[:half], csv, mark, quoted, good, odd)
            rows = rows[half:]
        else:
            odd.extend(rows[at].tolist())
            rows = np.delete(rows, at)
    odd.extend(rows.tolist())


def parse_batch(lines: pa.Array, layouts: pa.Array) -> tuple[pa.Table, pa.Array]:
    """The typed columns of a batch of lines (all null for bad lines) and the reason of each (null for good ones)."""
    n = len(lines)
    csv = pc.fill_null(pc.equal(layouts, "csv"), False)
    text = pc.replace_substring_regex(pc.fill_null(lines, ""), "\r$", "")
    mark = pc.struct_field(pc.extract_regex(text, r"^[0-9]+(?P<m>[\t -/:-~])"), 0)
    mark = pc.if_else(pc.and_(csv, pc.not_equal(mark, ",")), pa.scalar(None, pa.string()), mark)
    no_blocks = pc.or_(pc.is_null(mark), pc.fill_null(pc.is_in(mark, pa.array(['"', "="])), False))
    quoted = pc.match_substring_regex(text, '["\r\n]')
    kinds = pc.if_else(no_blocks, "", pc.binary_join_element_wise(pc.if_else(csv, "c", "o"), pc.if_else(quoted, "q", "p"), pc.fill_null(mark, ""), ""))
    coded = _one(kinds).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    good: list[tuple[np.ndarray, pa.Table]] = []
    odd: list[int] = []
    for code, kind in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(codes == code)
        if not kind:
            odd.extend(rows.tolist())
        else:
            csv_kind, mark_kind, quoted_kind = kind[0] == "c", kind[2:], kind[1] == "q"
            _bisect(text, rows, csv_kind, mark_kind, quoted_kind, good, odd)
    reasons: dict[int, str] = {}
    if odd:
        kept, loaded = [], []
        for row, line, layout in zip(odd, lines.take(pa.array(odd)).to_pylist(), layouts.take(pa.array(odd)).to_pylist()):
            reason, values = strict(line, layout)
            if reason:
                reasons[row] = reason
            else:
                kept.append(row)
                loaded.append(values)
        if kept:
            columns = [pa.array(c, t) for c, t in zip(zip(*loaded), _PARSED.types)]
            good.append((np.array(kept), pa.table(columns, schema=_PARSED)))
    table = pa.concat_tables([t for _, t in good]) if good else _PARSED.empty_table()
    place = np.full(n, -1, np.int64)
    if good:
        place[np.concatenate([rows for rows, _ in good])] = np.arange(table.num_rows)
    table = table.combine_chunks().take(pa.array(place, mask=place < 0))
    why = np.full(n, None, object)
    for row, reason in reasons.items():
        why[row] = reason
    return table, pa.array(why, pa.string())


def parse_lines(df: DataFrame, keep: Sequence[str] = (), line: str = "line", layout: str = "layout") -> DataFrame:
    """The columns ``keep`` of each line and reason, data_time, name, country, iata, height and tz.

    ``reason`` is null for a line that parses, whose typed columns are then filled; otherwise it is the first of
    'time', 'quoting', 'columns' and 'height' that applies (see ``strict``) and the typed columns are null. An empty
    height is null, other empty values are empty strings. One final carriage return is not part of a line. A null line
    fails by its time; a null layout is read as ``obs``. Repeated lines each have their row; an empty table gives no
    rows. A kept column called like a result column is renamed ``<name>_in``.
    """
    results = ("reason", "data_time", "data_time_us", *FIELDS)
    kept = without_clash(df.select(*(ref(k) for k in keep)), results).columns
    slim = df.select(*(ref(k).alias(name) for k, name in zip(keep, kept)), ref(line).alias("line_text"), ref(layout).alias("line_layout"))
    schema = T.StructType([*slim.schema.fields[: len(kept)], T.StructField("reason", T.StringType()), T.StructField("data_time_us", T.LongType()), *(T.StructField(f, T.DoubleType() if f == "height" else T.StringType()) for f in FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(kept)
            table, reasons = parse_batch(_one(batch.column(m)), _one(batch.column(m + 1)))
            columns = [batch.column(i) for i in range(m)] + [reasons] + [_one(c) for c in table.columns]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    out = slim.mapInArrow(run, schema)
    return out.select(*(ref(k) for k in kept), "reason", from_micros(F.col("data_time_us")).alias("data_time"), *FIELDS)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is not null")


def loaded(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason is null").drop("reason")

"""Lines of free-form observations: digits (microseconds), a delimiter, then ``field=value`` items.

This is the schemaless reader: any fields, in any order, kept as an array of (f, v). It is built from column
expressions only, so it works on batch and streaming sources alike and stays in generated code. ``sources.lines`` is
the strict reader for the five typed fields with quoting.

Rules: at most 20 leading digits are the time; the character after them is the delimiter of this line and must be
ASCII; the rest is split at every delimiter without any escape; an item is split at its first ``=``; an item without
``=`` has an empty value; a trailing delimiter gives one empty item. A line of digits only has no items. A line without
leading digits, or whose number is too large for a time, goes to the rejects with a reason. A null line is rejected
too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.columns import from_micros, ref, without_clash

DATA_TYPE = T.ArrayType(T.StructType([T.StructField("f", T.StringType()), T.StructField("v", T.StringType())]))
#: Of the digits that begin a line, so many belong to the time.
DIGITS = 20
#: The end of the year 9999; there are no timestamps beyond.
LAST_US = 253_402_300_799_999_999
REASONS = ("no leading time", "time out of range", "delimiter is not ASCII")
RESULTS = ("reason", "data_time", "data")


def items(rest: Column, delimiter: Column) -> Column:
    """``field=value`` items, separated by a literal delimiter, as array<struct<f, v>>."""
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    at = lambda x: F.instr(x, "=")
    parts = F.split(rest, quoted, -1)
    return F.transform(
        parts,
        lambda x: F.when(at(x) > 0, F.struct(F.substr(x, F.lit(1), at(x) - 1).alias("f"), F.substr(x, at(x) + 1).alias("v"))).otherwise(
            F.struct(x.alias("f"), F.lit("").alias("v"))
        ),
    )


def parse(df: DataFrame, line: str = "value") -> DataFrame:
    """``df`` with reason, data_time (TIMESTAMP_NTZ meaning UTC) and data; the latter two are null for a bad line.
    Columns called like these are renamed ``<name>_in``."""
    df = without_clash(df, (*RESULTS, "line_digits", "line_time"))
    text = ref(f"{line}_in" if line in RESULTS else line)
    # in steps of their own, so each is worked out once a line
    df = df.withColumn("line_digits", F.regexp_extract(text, rf"^([0-9]{{1,{DIGITS}}})", 1))
    df = df.withColumn("line_time", F.col("line_digits").try_cast("bigint"))
    n, time = F.length("line_digits"), F.col("line_time")
    delimiter = F.substr(text, n + 1, F.lit(1))
    reason = (
        F.when(text.isNull() | (n == 0), REASONS[0])
        .when(time.isNull() | (time > F.lit(LAST_US)), REASONS[1])
        .when((F.length(text) > n) & (F.octet_length(delimiter) > 1), REASONS[2])
    )
    df = df.withColumn("reason", reason)
    data = F.when(F.length(text) == n, F.array().cast(DATA_TYPE)).otherwise(items(F.substr(text, n + 2), delimiter))
    good = F.col("reason").isNull()
    return df.withColumns({"data_time": F.when(good, from_micros(time)), "data": F.when(good, data)}).drop("line_digits", "line_time")


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that parsed, without ``reason``, and the dead letters."""
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null").drop("data_time", "data")


def field(name: str, data: str = "data") -> Column:
    """The value of the first item with that field; null if there is none."""
    return F.try_element_at(F.filter(ref(data), lambda x: x["f"] == F.lit(name)), F.lit(1))["v"]


def number(value: Column) -> Column:
    """A decimal or exponent literal as a double; null for anything else, words like inf and suffixes included."""
    strict = value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    cast = F.when(strict, value.try_cast("double"))
    return F.when(F.abs(cast) < F.lit(float("inf")), cast)


def fields(df: DataFrame, names: Sequence[str], data: str = "data") -> DataFrame:
    """``df`` with a string column for each named field (columns of these names are replaced)."""
    return df.withColumns({n: field(n, data) for n in names})


def render(time_us: Column, pairs: Sequence[tuple[str, Column]], delimiter: str = "|") -> Column:
    """The line of an observation; null values leave their field out."""
    parts = [F.concat(F.lit(f + "="), v.cast("string")) for f, v in pairs]
    return F.concat_ws(delimiter, time_us.cast("string"), *parts)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one observation a line, as a batch."""
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Text files as they arrive, one posting each, with ``receive_time``: the file's time, which is one for all lines
    of a posting and stays the same when a batch runs again."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("value", F.col("_metadata.file_modification_time").alias("receive_time"))

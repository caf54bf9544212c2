"""Bloom filters as relations.

A filter of m bits is a table (word, bits) of 64-bit words, built by an aggregation that combines on the map side and
joined word by word when it is large. Filters of at most ``IN_PLACE_BITS`` bits, a size that is known beforehand, are
probed in place (up to IN_PLACE_HASHES hashes): the words become one array value that all tasks get, and a probe is an
expression.

Null values are neither added nor contained. '' is a value. Values are hashed as strings.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.sources.files import Files

#: 2 MB of words.
IN_PLACE_BITS = 1 << 24
IN_PLACE_HASHES = 32
MAX_HASHES = 255
#: The stored form begins with this byte, k in one byte and m in eight, low first.
VERSION = 1
_HEAD = struct.Struct("<BBQ")


@dataclass(frozen=True)
class Shape:
    """``m`` bits, ``k`` hashes."""

    m: int
    k: int

    @staticmethod
    def for_items(n: int, rate: float) -> Shape:
        """The usual optimum for n items at a rate of false positives."""
        m = math.ceil(-n * math.log(rate) / math.log(2) ** 2)
        return Shape(m, max(1, min(MAX_HASHES, math.ceil(math.log(2) * m / n))))

    @property
    def words(self) -> int:
        return (self.m + 63) // 64

    @property
    def size(self) -> int:
        """Bytes of the bits."""
        return 8 * self.words

    @property
    def head(self) -> bytes:
        return _HEAD.pack(VERSION, self.k, self.m)

    @staticmethod
    def of_head(data: bytes) -> Shape:
        """The shape that a stored filter begins with; another version and a shape that is none are errors."""
        if len(data) < _HEAD.size or data[0] != VERSION:
            raise ValueError("not a filter of this version")
        _, k, m = _HEAD.unpack(data[: _HEAD.size])
        if not 1 <= k <= MAX_HASHES or m < 1:
            raise ValueError("a filter without shape")
        return Shape(m, k)

    def positions(self, value: Column) -> Column:
        """The k bits of a value by double hashing, as an array of bigints."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.k - 1)), lambda i: self.position(value, i))

    def position(self, value: Column, i: Column) -> Column:
        m, text = F.lit(self.m).cast("bigint"), value.cast("string")
        a, b = F.pmod(F.xxhash64(text), m), F.pmod(F.xxhash64(text, F.lit(1)), m)
        return F.pmod(a + i * F.greatest(b, F.lit(1)), m)


def _bit(position: Column) -> Column:
    """1 << (position mod 64)."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))


def build(df: DataFrame, value: Column, shape: Shape) -> DataFrame:
    """(word, bits) of the words with any bit set."""
    at = df.where(value.isNotNull()).select(F.explode(shape.positions(value)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 64).cast("bigint").alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the values of both, which must have one shape."""
    return a.unionByName(b).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _dense(filter: DataFrame, shape: Shape) -> DataFrame:
    """One row with all words as an array; at most IN_PLACE_BITS / 64 words."""
    every = filter.sparkSession.range(shape.words).withColumnRenamed("id", "word")
    full = every.join(filter, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return full.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("words"))


def probe(df: DataFrame, value: Column, filter: DataFrame, shape: Shape, out: str = "contained") -> DataFrame:
    """``df`` with ``out``: whether the filter may contain the value (false: it does not)."""
    if shape.m <= IN_PLACE_BITS and shape.k <= IN_PLACE_HASHES:
        words, hit = _dense(filter, shape).scalar(), value.isNotNull()
        for i in range(shape.k):
            p = shape.position(value, F.lit(i))
            hit = hit & (F.get(words, F.floor(p / 64).cast("int")).bitwiseAND(_bit(p)) != 0)
        return df.withColumn(out, hit)
    numbered = df.withColumn("probe_value", value.cast("string"))
    # each distinct value is looked up once, so a heavy value is no heavy key
    once = numbered.select("probe_value").where("probe_value is not null").distinct()
    at = once.select("probe_value", F.explode(shape.positions(F.col("probe_value"))).alias("at"))
    at = at.withColumn("word", F.floor(F.col("at") / 64).cast("bigint"))
    hits = at.join(filter, "word", "left").groupBy("probe_value").agg(F.bool_and(F.coalesce(F.col("bits").bitwiseAND(_bit(F.col("at"))) != 0, F.lit(False))).alias(out))
    return numbered.join(hits, "probe_value", "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("probe_value")


def estimates(filter: DataFrame, shape: Shape) -> DataFrame:
    """One row: set_bits, n_items (an estimate of the items added) and false_rate (of the filter as it is filled)."""
    x = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    items = F.ceil(-F.log(1 - F.col("set_bits") / shape.m) * shape.m / shape.k)
    return filter.agg(x.alias("set_bits")).select("set_bits", F.when(F.col("set_bits") < shape.m, items).alias("n_items"), F.pow(F.col("set_bits") / shape.m, F.lit(shape.k)).alias("false_rate"))


def to_bytes(filter: DataFrame, shape: Shape) -> bytes:
    """A filter of at most IN_PLACE_BITS bits as one value: its head, then its words, low byte first. Larger ones are
    kept by ``save``."""
    if shape.m > IN_PLACE_BITS:
        raise ValueError("too large for one value")
    words = _dense(filter, shape).first()["words"]
    return shape.head + struct.pack(f"<{shape.words}q", *words)


def from_bytes(spark: SparkSession, data: bytes) -> tuple[DataFrame, Shape]:
    """The filter and its shape; missing or spare bytes and bits beyond m are errors."""
    shape = Shape.of_head(data)
    if len(data) != _HEAD.size + shape.size:
        raise ValueError("a filter of the wrong length")
    words = struct.unpack(f"<{shape.words}q", data[_HEAD.size :])
    if shape.m % 64 and (words[-1] & (1 << 64) - 1) >> shape.m % 64:
        raise ValueError("a filter with bits beyond its length")
    return spark.createDataFrame([(i, w) for i, w in enumerate(words) if w], "word bigint, bits bigint"), shape


def save(filter: DataFrame, shape: Shape, path: str) -> None:
    """Writes a filter of any size with its shape; the shape is written last."""
    files = Files(filter.sparkSession)
    files.drop(f"{path}/shape")
    filter.select("word", "bits").write.mode("overwrite").parquet(f"{path}/words")
    files.write(f"{path}/shape", shape.head)


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Shape]:
    """A filter that ``save`` wrote; another version, a spare byte or an unfinished one is an error."""
    head = Files(spark).read(f"{path}/shape")
    shape = Shape.of_head(head)
    if len(head) != _HEAD.size:
        raise ValueError("a filter of the wrong length")
    return spark.read.schema("word bigint, bits bigint").parquet(f"{path}/words"), shape

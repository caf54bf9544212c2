"""HyperLogLog as relations: registers, their union, and three estimators.

Registers are rows (keys, idx, rho); they are the maxima of an ordinary aggregation, so they combine on the map side and
their union is another one. The estimators need only how many registers have each value, at most 62 rows a key.

Rollups use the built-in sketch (``plans.measures``), which stores less. This form is for looking into a sketch,
comparing estimators, and hashes of one's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions import buckets
from tallyweir.functions.columns import ref
from tallyweir.functions.stats import error_of_estimate

#: The published empirical limits of linear counting for precisions 4 to 18.
LINEAR_LIMITS = (10, 20, 40, 80, 220, 400, 900, 1800, 3100, 6500, 11500, 20000, 50000, 120000, 350000)
LEAST_P, MOST_P = 4, 18
_ROUNDS = 60
#: The stored form: this byte, the precision, then the registers as packed counters of six bits.
VERSION, REGISTER_BITS = 1, 6


def _check(p: int) -> None:
    if not LEAST_P <= p <= MOST_P:
        raise ValueError(f"the precision is {LEAST_P} to {MOST_P}")


def alpha(m: int) -> float:
    """The published bias constant for m registers."""
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def registers(df: DataFrame, keys: Sequence[str], value: Column, p: int, hash: Column | None = None, hash_bits: int = 64) -> DataFrame:
    """keys, idx and rho of the registers that some value reached. Null values are left out; '' is a value.

    ``hash``: by default xxhash64 of the value; of another one the low ``hash_bits`` bits count.
    """
    _check(p)
    h = F.xxhash64(value) if hash is None else hash
    rest_bits = hash_bits - p
    idx = F.shiftrightunsigned(h, rest_bits).bitwiseAND(F.lit((1 << p) - 1).cast("bigint")).cast("int")
    rest = h.bitwiseAND(F.lit((1 << rest_bits) - 1).cast("bigint"))
    rho = F.when(rest == 0, rest_bits + 1).otherwise(F.lit(rest_bits + 1) - F.length(F.bin(rest)))
    rows = df.where(value.isNotNull()).select(*keys, idx.alias("idx"), rho.cast("int").alias("rho"))
    return rows.groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "idx").agg(F.max("rho").alias("rho"))


def _sigma(x: Column) -> Column:
    """The published series for the registers at zero: x + sum of x^(2^k) 2^(k-1); infinite at 1."""
    start = F.struct(x.alias("x"), F.lit(1.0).alias("y"), x.alias("z"))
    step = lambda s, _: F.struct((s["x"] * s["x"]).alias("x"), (s["y"] * 2).alias("y"), (s["z"] + s["x"] * s["x"] * s["y"]).alias("z"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step, lambda s: s["z"])
    return F.when(x >= 1, F.lit(float("inf"))).otherwise(series)


def _tau(x: Column) -> Column:
    """The published series for the registers at the top: (1 - x - sum of (1 - x^(2^-k))^2 2^-k) / 3."""
    start = F.struct(x.alias("x"), F.lit(1.0).alias("y"), (1 - x).alias("z"))

    def step(s: Column, _: Column) -> Column:
        root = F.sqrt(s["x"])
        return F.struct(root.alias("x"), (s["y"] / 2).alias("y"), (s["z"] - (1 - root) * (1 - root) * s["y"] / 2).alias("z"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, step, lambda s: s["z"] / 3)
    return F.when((x <= 0) | (x >= 1), F.lit(0.0)).otherwise(series)


def estimates(regs: DataFrame, keys: Sequence[str], p: int, hash_bits: int = 64) -> DataFrame:
    """keys, linear, harmonic, improved and estimate, as bigints rounded up.

    ``linear`` is null without empty registers. ``improved`` is the estimator that uses the Poisson model of the counts
    of register values. ``estimate`` is linear up to its limit for p, improved beyond.
    """
    _check(p)
    m, q = float(1 << p), hash_bits - p
    power = F.pow(F.lit(2.0), -F.col("rho"))
    sums = regs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("set"),
        F.sum(power).alias("all_sum"),
        F.sum(F.when(F.col("rho") <= q, power).otherwise(0.0)).alias("body"),
        F.count_if(F.col("rho") > q).alias("top"),
    )
    zero = F.lit(m) - F.col("set")
    linear = F.when(zero > 0, F.ceil(m * F.log(F.lit(m) / zero)))
    harmonic = F.ceil(alpha(1 << p) * m * m / (F.col("all_sum") + zero))
    z = m * _sigma(zero / m) + F.col("body") + m * _tau(1 - F.col("top") / m) * 2.0**-q
    improved = F.ceil(m * m / (2 * F.log(F.lit(2.0))) / z)
    return sums.select(
        *keys,
        linear.alias("linear"),
        harmonic.alias("harmonic"),
        improved.alias("improved"),
        F.when(linear <= LINEAR_LIMITS[p - LEAST_P], linear).otherwise(improved).alias("estimate"),
    )


def pack(values: np.ndarray, p: int) -> bytes:
    """All 2**p registers of a sketch as bytes."""
    _check(p)
    if len(values) != 1 << p:
        raise ValueError(f"a sketch of precision {p} has {1 << p} registers")
    return bytes([VERSION, p]) + buckets.pack(values, REGISTER_BITS)


def unpack(data: bytes) -> np.ndarray:
    """The registers of ``pack``; another version or precision, missing bytes and spare ones are errors."""
    if len(data) < 2 or data[0] != VERSION:
        raise ValueError("not a sketch of this version")
    _check(data[1])
    values = buckets.unpack(data[2:])
    if data[3] != REGISTER_BITS or len(values) != 1 << data[1]:
        raise ValueError("a sketch of the wrong length")
    return values


def size(p: int) -> int:
    """Bytes of ``pack``."""
    return 2 + buckets.size(1 << p, REGISTER_BITS)


def to_bytes(regs: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """keys and ``sketch``, a value of ``size(p)`` bytes for each key; a group holds at most 2**p registers."""
    _check(p)
    slim = regs.select(*(ref(k) for k in keys), "idx", "rho")
    schema = T.StructType([*(slim.schema[k] for k in keys), T.StructField("sketch", T.BinaryType())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        values = np.zeros(1 << p, np.int64)
        values[group.column("idx").to_numpy()] = group.column("rho").to_numpy()
        own = [pa.array([x.as_py()], group.schema.field(k).type) for k, x in zip(keys, key)]
        return pa.Table.from_arrays([*own, pa.array([pack(values, p)], pa.binary())], names=[*keys, "sketch"])

    return slim.groupBy(*(ref(k) for k in keys)).applyInArrow(run, schema)


def from_bytes(df: DataFrame, keys: Sequence[str], sketch: str = "sketch") -> DataFrame:
    """The registers (keys, idx, rho) of stored sketches; those of one key are united. Null sketches are empty ones;
    sketches of different precisions are an error, as is anything that ``unpack`` refuses."""
    slim = df.select(*(ref(k) for k in keys), ref(sketch).alias("__sketch")).where("__sketch is not null")
    schema = T.StructType([*(slim.schema[k] for k in keys), T.StructField("p", T.IntegerType()), T.StructField("idx", T.IntegerType()), T.StructField("rho", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(len(keys))):
                values = unpack(data.as_py())
                idx = np.flatnonzero(values)
                own = [batch.column(j).take(pa.array(np.full(len(idx), i))) for j in range(len(keys))]
                p = np.full(len(idx), (len(values) - 1).bit_length(), np.int32)
                yield pa.RecordBatch.from_arrays([*own, pa.array(p), pa.array(idx.astype(np.int32)), pa.array(values[idx].astype(np.int32))], names=schema.names)

    found = slim.mapInArrow(run, schema).groupBy(*(ref(k) for k in keys), "idx").agg(F.max("rho").alias("rho"), F.min("p").alias("low"), F.max("p").alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("rho")).otherwise(F.raise_error(F.lit("sketches of different precisions")).cast("int"))
    return found.select(*(ref(k) for k in keys), "idx", one.alias("rho"))


def error_sweep(spark: SparkSession, cases: Sequence[tuple[int, int]], seeds: int = 10) -> DataFrame:
    """p, d and the standard errors of estimate of the estimators over ``seeds`` sets of d random values."""
    out = None
    for p in sorted({p for p, _ in cases}):
        sets = [(d, seed) for q, d in cases if q == p for seed in range(seeds)]
        each = spark.createDataFrame(sets, "d bigint, seed int").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("d"))))
        value = F.xxhash64(F.lit("sweep"), F.col("seed"), F.col("i"))
        said = estimates(registers(each, ["d", "seed"], value, p), ["d", "seed"], p)
        errors = said.groupBy("d").agg(*(error_of_estimate(F.col(n), F.col("d")).alias(n) for n in ("linear", "harmonic", "improved", "estimate")))
        errors = errors.select(F.lit(p).alias("p"), *errors.columns)
        out = errors if out is None else out.unionByName(errors)
    return out

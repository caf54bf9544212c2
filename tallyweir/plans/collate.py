"""Rollups compiled to aggregate expressions, for batch and streaming DataFrames alike.

``state`` groups rows and keeps the mergeable parts, ``merge`` unites states, ``finish`` turns a state into measures and
``collate`` is ``finish(state(...))``: one partial aggregation, one shuffle of a row per key and task, one final
aggregation, whatever the number of measures.

Fields are columns of the input; string columns are read as numbers where a measure needs numbers (anything that is no
number is null and does not count). Null fields are left out by every measure, null keys leave out the row. Measures
without any value are null, except counts and uniquecount, which are 0. NaN is a number above all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.columns import ref
from tallyweir.plans.measures import PARTS
from tallyweir.plans.spec import ROWS, MeasureSpec, Rollup, SpecError
from tallyweir.sources.observations import number


def part_column(spec: MeasureSpec, part: str) -> str:
    return f"{'rows' if spec.field == ROWS else spec.field}__{part}" + (f"{spec.precision}" if part == "hll" else "")


def _parts(rollup: Rollup) -> dict[str, tuple[MeasureSpec, str]]:
    """State columns, each once, with a measure and part they belong to."""
    return {part_column(m, part): (m, part) for m in rollup.measures for part in m.measure.parts}


def _input(df: DataFrame, spec: MeasureSpec) -> Column:
    if spec.field == ROWS:
        return F.lit(1)
    kind = df.schema[spec.field].dataType
    if spec.measure.input == "text":
        return ref(spec.field).cast("string")
    if spec.measure.input == "any" or isinstance(kind, T.NumericType):
        return ref(spec.field)
    return number(ref(spec.field).cast("string"))


def _checked(df: DataFrame, rollup: Rollup) -> None:
    missing = [c for c in (*rollup.keys, *rollup.fields) if c not in df.columns]
    if missing:
        raise SpecError(f"rollup {rollup.name}: no column {', '.join(missing)}")


def routed(df: DataFrame, rollup: Rollup) -> DataFrame:
    """The rows that take part in the rollup."""
    _checked(df, rollup)
    if rollup.where is not None:
        df = df.where(rollup.where)
    for key in rollup.keys:
        df = df.where(ref(key).isNotNull())
    return df


def state(df: DataFrame, rollup: Rollup) -> DataFrame:
    rows = routed(df, rollup)
    columns = [PARTS[part].partial(_input(rows, m), m.precision).alias(name) for name, (m, part) in _parts(rollup).items()]
    return rows.groupBy(*(ref(k) for k in rollup.keys)).agg(*columns)


def merge(states: DataFrame, rollup: Rollup) -> DataFrame:
    """One state per key from several; types stay those of the states.

    All parts but m2 merge by an aggregate. m2 of the union is the sum of the parts' m2 and the squares of their means'
    distances to the common mean, each times the part's n. That second sum has to know the mean first, or to cancel large
    numbers, or else to come from an aggregate that merges distances, which Spark's ``var_pop`` is but for the weights n.
    So a part enters once for each hexadecimal digit of its n: parts are grouped by (key, digit's weight), where all
    weights are equal, and the at most 240 groups of a key are merged pairwise. Both aggregations combine before their
    shuffle, and no task sees the states of a heavy key one by one.
    """
    keys, parts = [ref(k) for k in rollup.keys], _parts(rollup)
    kinds = {name: states.schema[name].dataType for name in parts}
    spread = [name for name, (_, part) in parts.items() if PARTS[part].merge is None]
    hows = {name: PARTS[part].merge or F.sum for name, (_, part) in parts.items()}
    if not spread:
        return states.groupBy(*keys).agg(*(how(ref(name)).cast(kinds[name]).alias(name) for name, how in hows.items()))
    entries = [F.array(_entry(-1, F.lit(0).cast("bigint"), F.lit(None)))]
    for i, name in enumerate(spread):
        m = parts[name][0]
        entries.append(_entries(i, F.coalesce(ref(part_column(m, "n")), F.lit(0)).cast("bigint"), ref(part_column(m, "sum")).cast("double")))
    exploded = states.withColumn("__entry", F.explode(F.concat(*entries)))
    whole = F.col("__entry.part") == -1
    classes = exploded.groupBy(*keys, F.col("__entry.part").alias("__part"), F.col("__entry.weight").alias("__weight")).agg(
        *(how(F.when(whole, ref(name))).alias(name) for name, how in hows.items()),
        F.count("__entry.mean").alias("__n"),
        F.avg("__entry.mean").alias("__mean"),
        (F.var_pop("__entry.mean") * F.count("__entry.mean")).alias("__m2"),
    )
    weight = F.col("__weight").cast("double")
    moments = F.struct(F.col("__part").alias("part"), F.col("__weight").alias("weight"), (weight * F.col("__n")).alias("n"), F.col("__mean").alias("mean"), (weight * F.col("__m2")).alias("m2"))
    merged = classes.groupBy(*keys).agg(
        *(how(ref(name)).cast(kinds[name]).alias(name) for name, how in hows.items()),
        F.array_sort(F.collect_list(F.when(F.col("__part") >= 0, moments))).alias("__classes"),
    )
    for i, name in enumerate(spread):
        merged = merged.withColumn(name, F.coalesce(ref(name), F.lit(0.0)) + _apart(i))
    return merged.drop("__classes")


def _entry(part: int, weight: Column, mean: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), weight.alias("weight"), mean.cast("double").alias("mean"))


def _entries(part: int, n: Column, total: Column) -> Column:
    """An entry for each hexadecimal digit of n that is not 0."""
    weights = F.array(*(n.bitwiseAND(F.lit(15 << (4 * d)).cast("bigint")) for d in range(15)))
    return F.transform(F.filter(weights, lambda w: w > 0), lambda w: _entry(part, w, F.try_divide(total, n)))


def _apart(part: int) -> Column:
    """The sum of the squares of the means' distances to their mean, from the classes of weights."""
    own = F.filter("__classes", lambda c: c["part"] == part)
    zero = F.lit(0.0)
    return F.aggregate(own, _moments(zero, zero, zero), _pair, lambda x: x["m2"])


def _moments(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def _pair(a: Column, b: Column) -> Column:
    """The moments of the union of two sets of rows; b has some."""
    n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
    share = b["n"] / n
    return _moments(n, a["mean"] + apart * share, a["m2"] + b["m2"] + apart * apart * a["n"] * share)


def coarser(rollup: Rollup, keys: Sequence[str]) -> Rollup:
    """The rollup by some of its keys, which its states can answer too."""
    other = [k for k in keys if k not in rollup.keys]
    if other:
        raise SpecError(f"rollup {rollup.name} has no key {', '.join(other)}")
    return Rollup(rollup.name, tuple(keys), rollup.measures, rollup.where)


def finish(states: DataFrame, rollup: Rollup) -> DataFrame:
    results = [m.measure.finish(lambda part, m=m: ref(part_column(m, part))).alias(m.column) for m in rollup.measures]
    return states.select(*(ref(k) for k in rollup.keys), *results)


def collate(df: DataFrame, rollup: Rollup) -> DataFrame:
    """The keys and a column for each measure (count, sum_height, ...)."""
    return finish(state(df, rollup), rollup)


def states_many(df: DataFrame, rollups: Sequence[Rollup]) -> DataFrame:
    """The states of several rollups of one input by one scan and one aggregation: ``__rollup`` (the place in the list),
    the keys of all of them (null where a rollup lacks one) and all state columns, each filled for the rollups that need
    it. A row enters once for each rollup it takes part in, before the partial aggregation. A rollup without keys has
    its row also if there is no input."""
    uses: dict[str, tuple[MeasureSpec, str, list[int]]] = {}
    for i, r in enumerate(rollups):
        for name, (m, part) in _parts(r).items():
            uses.setdefault(name, (m, part, []))[2].append(i)
    keys = {k: [i for i, r in enumerate(rollups) if k in r.keys] for r in rollups for k in r.keys}
    takes = []
    for i, r in enumerate(rollups):
        _checked(df, r)
        part_of = F.lit(True) if r.where is None else r.where
        for k in r.keys:
            part_of = part_of & ref(k).isNotNull()
        takes.append(F.when(part_of, F.lit(i)))
    inputs = {name: _input(df, m).alias(f"__in_{j}") for j, (name, (m, _, _)) in enumerate(uses.items())}
    rows = df.select(F.array_compact(F.array(*takes)).alias("__takes"), *(ref(k) for k in keys), *inputs.values())
    rows = rows.select(F.explode("__takes").alias("__rollup"), *(ref(k) for k in keys), *(f"__in_{j}" for j in range(len(uses))))
    if keyless := [i for i, r in enumerate(rollups) if not r.keys]:
        seed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, keyless))).alias("__rollup"))
        rows = rows.unionByName(seed, allowMissingColumns=True)
    grouped = rows.groupBy("__rollup", *(F.when(F.col("__rollup").isin(own), ref(k)).alias(k) for k, own in keys.items()))
    return grouped.agg(*(PARTS[part].partial(F.when(F.col("__rollup").isin(own), F.col(f"__in_{j}")), m.precision).alias(name) for j, (name, (m, part, own)) in enumerate(uses.items())))


def states_of(many: DataFrame, rollups: Sequence[Rollup], i: int) -> DataFrame:
    """The states of one rollup from ``states_many``, which should be cached if several are taken."""
    return many.where(F.col("__rollup") == i).select(*(ref(k) for k in rollups[i].keys), *(ref(name) for name in _parts(rollups[i])))


def tagged(df: DataFrame, rollups: list[Rollup], columns: dict[str, str]) -> DataFrame:
    """Several rollups as one table, from one scan: rollup, key (the key values joined by a bar) and the named measures;
    ``columns`` gives the type of each."""
    key, rollup, measures = F.lit(None).cast("string"), F.lit(None).cast("string"), {c: F.lit(None) for c in columns}
    for i, r in enumerate(rollups):
        mine, own = F.col("__rollup") == i, {m.column: m for m in r.measures}
        key = F.when(mine, F.concat_ws("|", *(ref(k).cast("string") for k in r.keys))).otherwise(key)
        rollup = F.when(mine, F.lit(r.name)).otherwise(rollup)
        for c in columns:
            if c in own:
                m = own[c]
                measures[c] = F.when(mine, m.measure.finish(lambda part, m=m: ref(part_column(m, part)))).otherwise(measures[c])
    return states_many(df, rollups).select(rollup.alias("rollup"), key.alias("key"), *(measures[c].cast(kind).alias(c) for c, kind in columns.items()))

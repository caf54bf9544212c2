"""The queries of rollups, dialect, sketches, counters and windows."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir import gateway
from tallyweir.functions import fnv, stats
from tallyweir.functions.columns import micros
from tallyweir.operators import bloom, counters, hll, windowed
from tallyweir.plans import collate as c
from tallyweir.plans.engine import Engine
from tallyweir.plans.spec import MeasureSpec, Rollup
from tallyweir.registry import Registry
from tallyweir.session import scratch
from tallyweir.sources import observations
from tallyweir.sources.tables import arriving, stream_table, table
from tallyweir.streaming import rollup as stream_rollup
from tallyweir.streaming import windows as stream_windows

query = Registry()
QUERIES, SQL = query.queries, query.sql

HOUR, DAY = 3600 * 1_000_000, 86_400 * 1_000_000


def _measures(*texts: str) -> tuple[MeasureSpec, ...]:
    """'sum(value)', 'uniquecount(iata,10)', ..."""
    out = []
    for text in texts:
        name, inside = text.rstrip(")").split("(")
        field, _, precision = inside.partition(",")
        out.append(MeasureSpec(name, field, int(precision or 12)))
    return tuple(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """``value`` as a decimal, so sums are the same in any order."""
    return table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))


def _rounded(df: DataFrame) -> DataFrame:
    """Variances in single precision: the last digits of a double depend on the order of rows."""
    return df.withColumns({n: F.col(n).cast("float") for n in df.columns if n.startswith("var_")})


_D = "CAST(value AS DECIMAL(18,2))"
_SUM, _MEAN = f"sum({_D})::DOUBLE", f"sum({_D})::DOUBLE / count(value)"
_VAR = "var_samp(value)::FLOAT"


# --- measures by key


def _by_type(measure: str):
    rollup = Rollup("by_type", ("event_type",), _measures(measure))
    return lambda spark, d: _rounded(c.collate(_events(spark, d), rollup))


@query("SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def count_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("count(*)")(spark, d)


@query("SELECT event_type, count(value) AS count_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def count_field_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("count(value)")(spark, d)


@query(f"SELECT event_type, {_SUM} AS sum_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def sum_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("sum(value)")(spark, d)


@query(f"SELECT event_type, {_MEAN} AS mean_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def mean_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("mean(value)")(spark, d)


@query(f"SELECT event_type, {_VAR} AS var_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def var_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("var(value)")(spark, d)


@query("SELECT event_type, max(value) AS max_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def max_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("max(value)")(spark, d)


@query("SELECT event_type, min(value) AS min_value FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def min_by_key(spark: SparkSession, d: str) -> DataFrame:
    return _by_type("min(value)")(spark, d)


PRICES = Rollup("prices", ("l_returnflag",), _measures("count(*)", *(f"{m}(price)" for m in ("count", "sum", "mean", "var", "max", "min"))))


@query(
    """SELECT l_returnflag, count(*) AS count, count(price) AS count_price, sum(price)::DOUBLE AS sum_price, sum(price)::DOUBLE / count(price) AS mean_price,
       var_samp(price::DOUBLE)::FLOAT AS var_price, max(price)::DOUBLE AS max_price, min(price)::DOUBLE AS min_price
       FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem) WHERE l_returnflag IS NOT NULL GROUP BY 1"""
)
def collation_all_measures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return _rounded(c.collate(rows, PRICES))


@query("SELECT l_returnflag, l_linestatus, count(*) AS count, sum(CAST(l_quantity AS DECIMAL(18,2)))::DOUBLE AS sum_l_quantity FROM lineitem GROUP BY 1, 2")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))
    return c.collate(rows, Rollup("status", ("l_returnflag", "l_linestatus"), _measures("count(*)", "sum(l_quantity)")))


@query("SELECT count(*) AS count, max(o_totalprice) AS max_o_totalprice, min(o_totalprice) AS min_o_totalprice FROM orders")
def global_collation(spark: SparkSession, d: str) -> DataFrame:
    return c.collate(table(spark, d, "orders"), Rollup("all", (), _measures("count(*)", "max(o_totalprice)", "min(o_totalprice)")))


@query("SELECT o_orderpriority, count(*) AS count, max(o_totalprice) AS max_o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL GROUP BY 1")
def filtered_collation(spark: SparkSession, d: str) -> DataFrame:
    rollup = Rollup("done", ("o_orderpriority",), _measures("count(*)", "max(o_totalprice)"), where=F.col("o_orderstatus") == "F")
    return c.collate(table(spark, d, "orders"), rollup)


@query("SELECT nullif(event_type, 'view') AS kind, count(*) AS count FROM events WHERE event_type <> 'view' GROUP BY 1")
def missing_key_skipped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.nullif("event_type", F.lit("view")).alias("kind"))
    return c.collate(rows, Rollup("kinds", ("kind",), _measures("count(*)")))


#: The two rollups that are shown everywhere: records by country and by time zone.
COUNTRY = Rollup("country", ("country",), _measures("count(*)", "mean(height)", "sum(height)", "var(height)", "max(height)", "min(height)", "uniquecount(iata,10)"))
ZONE = Rollup("tz", ("tz",), _measures("count(*)", "uniquecount(country,8)", "uniquecount(height,8)"))


def _heights(spark: SparkSession, d: str) -> DataFrame:
    """Observations with height as an exact number; NaN is left out."""
    exact = F.when(~F.isnan("height"), F.col("height")).cast("decimal(18,6)")
    return table(spark, d, "observation").withColumn("height", exact)


_HEIGHTS = "(SELECT *, CAST(CASE WHEN NOT isnan(height) THEN height END AS DECIMAL(18,6)) AS h FROM observation)"


@query(
    f"""SELECT country, count(*) AS count, sum(h)::DOUBLE / count(h) AS mean_height, sum(h)::DOUBLE AS sum_height, var_samp(h::DOUBLE)::FLOAT AS var_height,
        max(h)::DOUBLE AS max_height, min(h)::DOUBLE AS min_height FROM {_HEIGHTS} WHERE country IS NOT NULL GROUP BY 1"""
)
def country_collation(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(c.collate(_heights(spark, d), COUNTRY)).drop("uniquecount_iata")


@query("SELECT country, count(DISTINCT iata) AS exact, true AS within_bound FROM observation WHERE country IS NOT NULL GROUP BY 1")
def uniquecount_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether each country's estimate is within six standard errors of the exact count (two for small ones)."""
    rows = table(spark, d, "observation")
    exact = rows.groupBy("country", "iata").agg(F.lit(1)).groupBy("country").agg(F.count("iata").alias("exact"))
    both = c.collate(rows, COUNTRY).select("country", "uniquecount_iata").join(exact, "country")
    return both.select("country", "exact", (F.abs(F.col("uniquecount_iata") - F.col("exact")) <= 2 + 6 * 1.04 / 2**5 * F.col("exact")).alias("within_bound"))


@query(
    """SELECT count(*) AS n_keys, true AS mean_within, true AS spread_within FROM (SELECT country FROM observation WHERE country IS NOT NULL GROUP BY country HAVING count(DISTINCT iata) >= 20)"""
)
def uniquecount_mean_error(spark: SparkSession, d: str) -> DataFrame:
    """Over the countries of at least 20 codes: the mean relative error is near 0, and errors spread no more than the
    sketch's standard error."""
    rows = table(spark, d, "observation")
    exact = rows.groupBy("country", "iata").agg(F.lit(1)).groupBy("country").agg(F.count("iata").alias("exact")).where("exact >= 20")
    off = c.collate(rows, COUNTRY).join(exact, "country").select((F.col("uniquecount_iata") / F.col("exact") - 1).alias("off"))
    n, sigma = F.count(F.lit(1)), 1.04 / 2**5
    return off.agg(n.alias("n_keys"), (F.abs(F.avg("off")) <= 5 * sigma / F.sqrt(n)).alias("mean_within"), (F.sqrt(F.avg(F.col("off") * F.col("off"))) <= 1.5 * sigma).alias("spread_within"))


@query("SELECT tz, count(*) AS count, true AS countries_within, true AS heights_within FROM observation WHERE tz IS NOT NULL GROUP BY 1")
def tz_collation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "observation")
    exact = lambda f: rows.groupBy("tz", f).agg(F.lit(1)).groupBy("tz").agg(F.count(f).alias(f"exact_{f}"))
    both = c.collate(rows, ZONE).join(exact("country"), "tz").join(exact("height"), "tz")
    within = lambda f: F.abs(F.col(f"uniquecount_{f}") - F.col(f"exact_{f}")) <= 2 + 6 * 1.04 / 2**4 * F.col(f"exact_{f}")
    return both.select("tz", "count", within("country").alias("countries_within"), within("height").alias("heights_within"))


# --- many rollups, merging, queries


@query(
    f"""SELECT 'by_type' AS rollup, event_type AS key, count(*) AS count, {_SUM} AS sum_value FROM events WHERE event_type IS NOT NULL GROUP BY event_type
        UNION ALL SELECT 'by_user', user_id::VARCHAR, count(*), NULL FROM events WHERE user_id IS NOT NULL GROUP BY user_id
        UNION ALL SELECT 'rows', '', count(*), {_SUM} FROM events"""
)
def multi_collation_union(spark: SparkSession, d: str) -> DataFrame:
    rollups = [
        Rollup("by_type", ("event_type",), _measures("count(*)", "sum(value)")),
        Rollup("by_user", ("user_id",), _measures("count(*)")),
        Rollup("rows", (), _measures("count(*)", "sum(value)")),
    ]
    return c.tagged(_events(spark, d), rollups, {"count": "bigint", "sum_value": "double"})


VALUES = Rollup("values", ("event_type",), _measures("count(*)", *(f"{m}(value)" for m in ("count", "sum", "mean", "var", "max", "min"))))
_VALUES = f"""SELECT event_type, count(*) AS count, count(value) AS count_value, {_SUM} AS sum_value, {_MEAN} AS mean_value, {_VAR} AS var_value,
    max(value) AS max_value, min(value) AS min_value FROM events WHERE event_type IS NOT NULL GROUP BY 1"""


@query(_VALUES)
def rollup_merge(spark: SparkSession, d: str) -> DataFrame:
    """States of seven portions, merged, are the state of all rows."""
    rows = _events(spark, d).withColumn("portion", F.pmod("user_id", F.lit(7)))
    by_portion = Rollup("portions", ("event_type", "portion"), VALUES.measures)
    return _rounded(c.finish(c.merge(c.state(rows, by_portion).drop("portion"), VALUES), VALUES))


@query(_VALUES)
def rollup_coarser(spark: SparkSession, d: str) -> DataFrame:
    """States by type and user answer for the types."""
    fine = Rollup("values", ("event_type", "user_id"), VALUES.measures)
    by_type = c.coarser(fine, ["event_type"])
    return _rounded(c.finish(c.merge(c.state(_events(spark, d), fine), by_type), by_type))


USER_TYPES = Rollup("user_types", ("event_type", "user_id"), _measures("count(*)", "sum(value)", "max(value)"))


def _engine(spark: SparkSession, d: str, strict: bool = True) -> Engine:
    engine = Engine(strict)
    rows = _events(spark, d)
    engine.create_from(VALUES, rows)
    engine.create_from(USER_TYPES, rows)
    engine.create_from(Rollup("rows", (), _measures("count(*)")), rows)
    return engine


@query(f"SELECT count(*) AS count, {_MEAN} AS mean_value, max(value) AS max_value FROM events WHERE event_type = 'error'")
def point_query(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).query("values", "select count(*), mean(value), max(value) where event_type='error'")


@query(f"SELECT {_SUM} AS sum_value, count(*) AS count FROM events WHERE event_type = 'click' AND user_id = 8 HAVING count(*) > 0")
def point_query_multi(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).query("user_types", "SeLeCt sum(value),count(*) whERE user_id='8' and event_type='click'")


@query("SELECT 'there' AS asked, count(*) AS count, max(value) AS max_value FROM events WHERE event_type = 'click' HAVING count(*) > 0")
def point_query_absent(spark: SparkSession, d: str) -> DataFrame:
    """An unknown key value and a key without criterion give no row; the same question with the key answered does."""
    engine = _engine(spark, d)
    asked = {
        "there": engine.query("values", "select count(*), max(value) where event_type='click'"),
        "unknown": engine.query("values", "select count(*), max(value) where event_type='no such type'"),
        "incomplete": engine.query("user_types", "select count(*), max(value) where event_type='click'"),
    }
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("asked"), "count", "max_value") for name, rows in asked.items()))


@query(
    """SELECT unnest([1, 2, 3])::INTEGER AS line, unnest(['event_type=error', 'max(value)=' || CASE WHEN m = floor(m) THEN m::BIGINT::VARCHAR ELSE m::VARCHAR END, 'count(*)=' || n]) AS text
       FROM (SELECT max(value) AS m, count(*) AS n FROM events WHERE event_type = 'error')"""
)
def gateway_answer(spark: SparkSession, d: str) -> DataFrame:
    """A question as the HTTP front gets it, and the text that it answers."""
    text = gateway.answer(_engine(spark, d), "/collation/values", "select max(value), count(*) where event_type='error'")
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, text string")


@query("SELECT event_type, user_id, count(*) AS count FROM events WHERE event_type = 'click' AND user_id IS NOT NULL GROUP BY 1, 2")
def point_query_partial_keys(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).query("user_types", "select count(*) where event_type='click'", partial_keys=True)


@query("SELECT count(*) AS count FROM events WHERE event_type = 'view'")
def point_query_lenient(spark: SparkSession, d: str) -> DataFrame:
    """Without strictness, unknown measures and fields are passed over."""
    return _engine(spark, d, strict=False).query("values", "select count(*) median(value) where event_type='view' or colour='red'")


def _kept(spark: SparkSession, d: str) -> Engine:
    """An engine over rollups that a stream keeps, after four micro-batches and a compaction."""
    folder = scratch(spark)
    tables = [stream_rollup.RollupTable(spark, f"{folder}/{r.name}", r, compact_every=3) for r in (VALUES, USER_TYPES)]
    stream_rollup.keep(arriving(spark, _events(spark, d), f"{folder}/in", 4), tables, f"{folder}/checkpoint", available_now=True).awaitTermination()
    engine = Engine()
    for t in tables:
        engine.create_kept(t)
    return engine


@query(f"""SELECT 'values' AS rollup, count(*) AS count, {_SUM} AS sum_value, max(value) AS max_value, {_VAR} AS var_value FROM events WHERE event_type = 'error'
    UNION ALL SELECT 'user_types', count(*), {_SUM}, max(value), NULL FROM events WHERE event_type = 'click' AND user_id = 8 HAVING count(*) > 0""")
def point_query_kept(spark: SparkSession, d: str) -> DataFrame:
    """Questions to kept rollups, which read the states of the key asked for and no rows."""
    engine = _kept(spark, d)
    one = engine.query("values", "select count(*), sum(value), max(value), var(value) where event_type='error'").withColumn("rollup", F.lit("values"))
    two = engine.query("user_types", "select count(*), sum(value), max(value) where user_id='8' and event_type='click'").withColumn("rollup", F.lit("user_types"))
    return _rounded(one.unionByName(two, allowMissingColumns=True)).select("rollup", "count", "sum_value", "max_value", "var_value")


@query(
    """SELECT * FROM (SELECT 'country' AS name, count(DISTINCT country) AS n_keys, 836 * count(DISTINCT country) AS bytes FROM observation
       UNION ALL SELECT 'tz', count(DISTINCT tz), 416 * count(DISTINCT tz) FROM observation)"""
)
def collation_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The rollups of an engine by name, how many keys each has and the estimated bytes of their states."""
    engine, rows = Engine(), table(spark, d, "observation")
    for rollup in (COUNTRY, ZONE):
        engine.create_from(rollup, rows)
    sizes = []
    for name in engine.names():
        keys = engine.table(name).agg(F.count(F.lit(1)).alias("n_keys"))
        sizes.append(keys.select(F.lit(name).alias("name"), "n_keys", (F.lit(engine.rollup(name).bytes_per_key()).cast("bigint") * F.col("n_keys")).alias("bytes")))
    return reduce(DataFrame.unionByName, sizes)


# --- observation lines


@query(
    """SELECT event_type, count(*) AS count, sum(CAST(value AS DECIMAL(18,2)))::DOUBLE AS sum_value, min(ts) AS first_time, max(ts) AS last_time
       FROM events WHERE event_type IS NOT NULL GROUP BY 1"""
)
def obs_parse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events written to text files with three delimiters, read again and aggregated."""
    pairs = [("event_type", F.col("event_type")), ("value", F.col("value")), ("props", F.col("props"))]
    lines = [observations.render(micros(F.col("ts")), pairs, mark) for mark in ("|", "\t", "\\")]
    line = F.when(F.pmod("event_id", F.lit(3)) == 0, lines[0]).when(F.pmod("event_id", F.lit(3)) == 1, lines[1]).otherwise(lines[2])
    folder = f"{scratch(spark)}/lines"
    _events(spark, d).select(line.alias("value")).write.text(folder)
    good, _ = observations.split(observations.parse(observations.read_lines(spark, folder)))
    rows = observations.fields(good, ["event_type", "value"]).withColumn("value", F.col("value").try_cast("decimal(18,2)"))
    sums = rows.where("event_type is not null").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("count"), F.sum("value").cast("double").alias("sum_value"), F.min("data_time").alias("first_time"), F.max("data_time").alias("last_time")
    )
    return sums


@query(
    """SELECT reason, count(*) AS n_lines, coalesce(sum(k), 0)::BIGINT AS n_items FROM (SELECT
         CASE WHEN n = 0 THEN 'no leading time' WHEN TRY_CAST(digits AS BIGINT) IS NULL OR TRY_CAST(digits AS BIGINT) > 253402300799999999 THEN 'time out of range' END AS reason,
         CASE WHEN n = 0 OR TRY_CAST(digits AS BIGINT) IS NULL OR TRY_CAST(digits AS BIGINT) > 253402300799999999 THEN 0 WHEN length(line) = n THEN 0 ELSE len(string_split(substr(line, n + 2), substr(line, n + 1, 1))) END AS k
       FROM (SELECT line, digits, length(digits) AS n FROM (SELECT line, regexp_extract(line, '^[0-9]{1,20}') AS digits FROM raw_line))) GROUP BY 1"""
)
def obs_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """The schemaless reader over all posted lines: items by reason (null: parsed)."""
    parsed = observations.parse(table(spark, d, "raw_line").select("line"), "line")
    return parsed.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum(F.size(F.coalesce("data", F.array().cast(observations.DATA_TYPE)))), F.lit(0)).cast("bigint").alias("n_items"))


@query("SELECT x.f AS field, count(*) AS n, count(DISTINCT x.v) AS n_values FROM (SELECT unnest(data) AS x FROM obs_row) GROUP BY 1")
def obs_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which fields occur in schemaless rows, how often and with how many values."""
    x = table(spark, d, "obs_row").select(F.explode("data").alias("x"))
    pairs = x.groupBy(F.col("x.f").alias("field"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("field").agg(F.sum("n").alias("n"), F.count("v").alias("n_values"))


_FIRST = "list_filter(data, lambda x: x.f = '{f}')[1].v"


@query(
    f"""SELECT country, count(*) AS count, count(h) AS count_height, max(h) AS max_height FROM (SELECT {_FIRST.format(f='country')} AS country,
        CASE WHEN regexp_full_match({_FIRST.format(f='height')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({_FIRST.format(f='height')} AS DOUBLE) END AS h FROM obs_row)
        WHERE country IS NOT NULL GROUP BY 1"""
)
def obs_rollup(spark: SparkSession, d: str) -> DataFrame:
    """A rollup straight over schemaless rows: first occurrence of a field, '' a key, heights that are no numbers left out."""
    rows = observations.fields(table(spark, d, "obs_row"), ["country", "height"])
    rows = rows.withColumn("height", observations.number(F.col("height")))
    return c.collate(rows, Rollup("country", ("country",), _measures("count(*)", "count(height)", "max(height)")))


@query(
    f"""SELECT country, count(*) AS count, min(h) AS min_height, max(h) AS max_height FROM (SELECT {_FIRST.format(f='country')} AS country,
        CASE WHEN regexp_full_match({_FIRST.format(f='height')}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({_FIRST.format(f='height')} AS DOUBLE) END AS h FROM obs_row)
        WHERE country IS NOT NULL GROUP BY 1"""
)
def obs_rollup_of_text(spark: SparkSession, d: str) -> DataFrame:
    """Measures that need numbers over a field that is text: the rollup reads the numbers itself."""
    rows = observations.fields(table(spark, d, "obs_row"), ["country", "height"])
    return c.collate(rows, Rollup("country", ("country",), _measures("count(*)", "min(height)", "max(height)")))


# --- counters, statistics, hashes


@query("SELECT l_partkey AS key, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1")
def counter_map(spark: SparkSession, d: str) -> DataFrame:
    return counters.counter_map(table(spark, d, "lineitem"), F.col("l_partkey"), F.col("l_quantity").cast("bigint"))


@query("SELECT l_partkey % 64 AS bucket, least(sum(CAST(l_quantity AS BIGINT)) // 1000, 15)::INTEGER AS value FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) // 1000 > 0")
def saturating_buckets(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "lineitem").groupBy(F.pmod("l_partkey", F.lit(64)).alias("b")).agg(F.floor(F.sum(F.col("l_quantity").cast("bigint")) / 1000).alias("n"))
    return counters.saturating_buckets(sums, F.col("b"), F.col("n"), 64, 4)


@query(f"SELECT event_type, count(value) AS n, {_MEAN} AS mean, CASE WHEN count(value) > 1 THEN var_pop(value)::FLOAT END AS variance FROM events GROUP BY 1")
def meanvar_population(spark: SparkSession, d: str) -> DataFrame:
    found = _events(spark, d).groupBy("event_type").agg(stats.mean_and_variance(F.col("value")).alias("s"), F.sum("value").cast("double").alias("sum"))
    return found.select("event_type", "s.n", F.try_divide("sum", "s.n").alias("mean"), F.col("s.variance").cast("float").alias("variance"))


@query("SELECT event_type, CASE WHEN count(*) > 2 THEN sqrt(sum(pow(value - 20.0, 2)) / (count(*) - 2))::FLOAT END AS error FROM events GROUP BY 1")
def stderr_of_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(stats.error_of_estimate(F.col("value"), F.lit(20.0)).cast("float").alias("error"))


def _fnv_sql(xor_first: bool, text: str = "iata") -> str:
    byte = f"('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::UHUGEINT"
    step = "xor(h, b) * 1099511628211 % 18446744073709551616" if xor_first else "xor(h * 1099511628211 % 18446744073709551616, b)"
    return f"""SELECT iata, (list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(strlen({text})), lambda i: {byte})), lambda h, b: {step}))::VARCHAR AS hash
        FROM airport"""


def _fnv(df: DataFrame, f) -> DataFrame:
    h = f(F.col("iata")) if callable(f) else f
    unsigned = F.when(h < 0, h.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(h.cast("decimal(20,0)"))
    return df.select("iata", unsigned.cast("decimal(20,0)").cast("string").alias("hash"))


@query(_fnv_sql(False))
def fnv1_hash(spark: SparkSession, d: str) -> DataFrame:
    return _fnv(table(spark, d, "airport"), fnv.fnv1)


@query(_fnv_sql(True))
def fnv1a_hash(spark: SparkSession, d: str) -> DataFrame:
    return _fnv(table(spark, d, "airport"), fnv.fnv1a)


@query(_fnv_sql(True, "(iata || name)"))
def fnv1a_continued(spark: SparkSession, d: str) -> DataFrame:
    """The hash of two fields one after the other, continued from that of the first."""
    return _fnv(table(spark, d, "airport"), fnv.fnv1a(F.col("name"), start=fnv.fnv1a(F.col("iata"))))


# --- HyperLogLog, Bloom, top-k, frequency, quantiles


@query(
    """SELECT event_type, (h >> 50)::INTEGER AS idx, max(CASE WHEN h & 1125899906842623 = 0 THEN 51 ELSE 51 - length(bin(h & 1125899906842623)) END)::INTEGER AS rho
       FROM (SELECT event_type, ('0x' || substr(md5(user_id::VARCHAR), 1, 15))::BIGINT AS h FROM events WHERE user_id IS NOT NULL) GROUP BY 1, 2"""
)
def hll_registers(spark: SparkSession, d: str) -> DataFrame:
    """Registers of precision 10 over 60 bits of another hash."""
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    return hll.registers(table(spark, d, "events"), ["event_type"], F.col("user_id"), 10, h, 60)


@query(SQL["hll_registers"])
def hll_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same registers after they were stored as bytes, half of the rows in each sketch, and united."""
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 15), 16, 10).cast("bigint")
    rows = table(spark, d, "events")
    halves = [hll.to_bytes(hll.registers(rows.where(F.pmod("event_id", F.lit(2)) == i), ["event_type"], F.col("user_id"), 10, h, 60), ["event_type"], 10) for i in (0, 1)]
    return hll.from_bytes(halves[0].unionByName(halves[1]), ["event_type"])


@query(
    """SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS improved_within, true AS estimate_within
       FROM lineitem GROUP BY 1"""
)
def hll_estimates_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of precision 12 within six standard errors."""
    rows, keys = table(spark, d, "lineitem"), ["l_returnflag"]
    said = hll.estimates(hll.registers(rows, keys, F.col("l_partkey"), 12), keys, 12)
    exact = rows.groupBy("l_returnflag", "l_partkey").agg(F.lit(1)).groupBy(*keys).agg(F.count("l_partkey").alias("exact"))
    near = lambda x: F.abs(F.col(x) - F.col("exact")) <= 2 + 6 * 1.04 / 64 * F.col("exact")
    return said.join(exact, keys).select(*keys, "exact", near("improved").alias("improved_within"), near("estimate").alias("estimate_within"))


@query(
    """SELECT count(*) AS n_keys, true AS all_beyond, true AS harmonic_each, true AS harmonic_mean, true AS improved_mean, true AS estimate_mean
       FROM (SELECT l_suppkey % 25 FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1)"""
)
def hll_mean_errors(spark: SparkSession, d: str) -> DataFrame:
    """Estimators of precision 4 where each key has at least 5 * 2**4 distinct values, so that the harmonic one is not
    biased: each estimate within five standard errors, and the mean error over keys within five of its own."""
    p, keys = 4, ["k"]
    rows = table(spark, d, "lineitem").where("l_suppkey is not null").select(F.pmod("l_suppkey", F.lit(25)).alias("k"), "l_orderkey")
    said = hll.estimates(hll.registers(rows, keys, F.col("l_orderkey"), p), keys, p)
    exact = rows.groupBy("k", "l_orderkey").agg(F.lit(1)).groupBy("k").agg(F.count("l_orderkey").alias("exact"))
    off = lambda x: F.col(x) / F.col("exact") - 1
    sigma, n = 1.04 / 4, F.count(F.lit(1))
    mean = lambda x: (F.abs(F.avg(off(x))) <= 5 * sigma / F.sqrt(n) + 0.01).alias(f"{x}_mean")
    return said.join(exact, keys).agg(
        n.alias("n_keys"), F.min(F.col("exact") >= 5 << p).alias("all_beyond"), F.max(F.abs(off("harmonic")) <= 5 * sigma).alias("harmonic_each"), *map(mean, ("harmonic", "improved", "estimate"))
    )


SHAPE = bloom.Shape.for_items(100_000, 0.01)


@query("SELECT (SELECT count(*) FROM key_log WHERE iata IS NOT NULL) AS probes, 0::BIGINT AS missed")
def bloom_no_false_negatives(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "key_log").where("iata is not null")
    probed = bloom.probe(log, F.col("iata"), bloom.build(log, F.col("iata"), SHAPE), SHAPE)
    return probed.agg(F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("contained")).alias("missed"))


@query(SQL["bloom_no_false_negatives"])
def bloom_stored(spark: SparkSession, d: str) -> DataFrame:
    """The same by a filter that was stored and read again with its shape."""
    log = table(spark, d, "key_log").where("iata is not null")
    folder = scratch(spark)
    bloom.save(bloom.build(log, F.col("iata"), SHAPE), SHAPE, folder)
    made, shape = bloom.load(spark, folder)
    return bloom.probe(log, F.col("iata"), made, shape).agg(F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("contained")).alias("missed"))


@query("SELECT count(DISTINCT iata) AS exact, true AS within_bound FROM key_log")
def bloom_count_within_bound(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "key_log")
    said = bloom.estimates(bloom.build(log, F.col("iata"), SHAPE), SHAPE)
    exact = log.groupBy("iata").agg(F.lit(1)).agg(F.count("iata").alias("exact"))
    near = F.abs(said.select("n_items").scalar() - F.col("exact")) <= 10 + 0.02 * F.col("exact")
    return exact.select("exact", near.alias("within_bound"))


@query("SELECT count(*) AS probes, true AS rate_within FROM (SELECT DISTINCT iata FROM airport WHERE iata NOT IN (SELECT iata FROM key_log WHERE iata IS NOT NULL))")
def bloom_false_positive_rate(spark: SparkSession, d: str) -> DataFrame:
    """Codes that the log lacks, against three times the filter's own rate."""
    log = table(spark, d, "key_log")
    lacking = table(spark, d, "airport").select("iata").distinct().join(log.select("iata"), "iata", "left_anti")
    made = bloom.build(log, F.col("iata"), SHAPE)
    probed = bloom.probe(lacking, F.col("iata"), made, SHAPE)
    rate = bloom.estimates(made, SHAPE).select("false_rate").scalar()
    return probed.agg(F.count(F.lit(1)).alias("probes"), (F.count_if("contained") <= 10 + 3 * rate * F.count(F.lit(1))).alias("rate_within"))


@query(
    """SELECT event_type, place::INTEGER AS place, value, n FROM (SELECT event_type, user_id AS value, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS place
       FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2) WHERE place <= 10"""
)
def top_k_exact(spark: SparkSession, d: str) -> DataFrame:
    return counters.top_k(table(spark, d, "events"), ["event_type"], F.col("user_id"), 10)


@query("SELECT row_number() OVER (ORDER BY n DESC, value)::INTEGER AS place, value, n FROM (SELECT iata AS value, count(*) AS n FROM observation WHERE iata IS NOT NULL GROUP BY 1) ORDER BY n DESC, value LIMIT 20")
def top_k_global(spark: SparkSession, d: str) -> DataFrame:
    return counters.top_k(table(spark, d, "observation"), [], F.col("iata"), 20)


@query(
    """SELECT event_type, place::INTEGER AS place, n FROM (SELECT event_type, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC) AS place
       FROM events WHERE user_id IS NOT NULL GROUP BY event_type, user_id) WHERE place <= 10"""
)
def top_k_approx(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the ten commonest users; the sketch is exact while it tracks all of them."""
    top = counters.top_k_approx(table(spark, d, "events"), ["event_type"], F.col("user_id"), 10)
    counts = top.groupBy("event_type").agg(F.sort_array(F.collect_list("n"), False).alias("counts"))
    return counts.select("event_type", F.posexplode("counts").alias("i", "n")).select("event_type", (F.col("i") + 1).alias("place"), "n")


@query("SELECT l_partkey AS value, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1")
def frequency_exact(spark: SparkSession, d: str) -> DataFrame:
    return counters.frequencies(table(spark, d, "lineitem"), [], F.col("l_partkey"))


@query("SELECT count(DISTINCT l_partkey) AS n_values, 0::BIGINT AS too_low, true AS few_too_high FROM lineitem")
def frequency_sketch_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Count-min estimates are never too low, and hardly any is too high by more than e / width of all rows."""
    rows, sketch = table(spark, d, "lineitem"), counters.CountMin()
    exact = counters.frequencies(rows, [], F.col("l_partkey")).withColumnRenamed("n", "exact")
    said = sketch.estimate(sketch.build(rows, F.col("l_partkey")), rows, F.col("l_partkey")).join(exact, "value")
    slack = 2.71828 / sketch.width * F.sum("exact")
    sums = said.agg(F.count(F.lit(1)).alias("n_values"), F.count_if(F.col("n") < F.col("exact")).alias("too_low"), slack.alias("slack"))
    high = said.where(F.col("n") > F.col("exact") + sums.select("slack").scalar()).agg(F.count(F.lit(1)).alias("h")).scalar()
    return sums.select("n_values", "too_low", (high <= 1 + 0.01 * F.col("n_values")).alias("few_too_high"))


@query("SELECT event_type, CASE WHEN value >= 200 THEN 20 WHEN value < 0 THEN -1 ELSE floor(value / 10) END::INTEGER AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def histogram_fixed_bins(spark: SparkSession, d: str) -> DataFrame:
    return counters.histogram(table(spark, d, "events"), ["event_type"], F.col("value"), 0.0, 10.0, 20)


@query("SELECT event_type, unnest([0.25, 0.5, 0.75])::DOUBLE AS share, count(value) AS n, true AS within_bound FROM events GROUP BY 1")
def quantiles_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the built-in summary's quantiles are within a thousandth of their rank."""
    rows, shares = table(spark, d, "events"), [0.25, 0.5, 0.75]
    said = counters.quantiles_approx(rows, ["event_type"], F.col("value"), shares)
    pairs = said.select("event_type", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("quantiles").alias("v"))).alias("q"))
    counts = rows.groupBy("event_type", "value").agg(F.count("value").alias("n"))
    at = counts.join(pairs, "event_type").groupBy("event_type", F.col("q.share").alias("share")).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("value") < F.col("q.v"), F.col("n")).otherwise(0)).alias("less"),
        F.sum(F.when(F.col("value") <= F.col("q.v"), F.col("n")).otherwise(0)).alias("upto"),
    )
    wanted, slack = F.col("share") * F.col("n"), 1 + F.col("n") / 1000
    return at.select("event_type", "share", "n", ((F.col("less") <= wanted + slack) & (F.col("upto") >= wanted - slack)).alias("within_bound"))


# --- windows

FROM, UNTIL, NOW = datetime(2024, 1, 5), datetime(2024, 1, 12, 12), datetime(2024, 1, 20)


def _count() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "sum_value": F.sum("value").cast("double")}




@query(f"SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket_start, count(*) AS n, {_SUM} AS sum_value FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2")
def bucketed_count(spark: SparkSession, d: str) -> DataFrame:
    return windowed.bucketed(_events(spark, d), ["event_type"], "ts", HOUR, _count())


@query(f"SELECT event_type, count(*) AS n, {_SUM} AS sum_value FROM events WHERE ts > TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00' AND event_type IS NOT NULL GROUP BY 1")
def windowed_count(spark: SparkSession, d: str) -> DataFrame:
    return windowed.windowed(_events(spark, d), ["event_type"], "ts", FROM, UNTIL, _count())


@query(f"SELECT event_type, count(*) AS n, {_SUM} AS sum_value FROM events WHERE ts > TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-20' AND event_type IS NOT NULL GROUP BY 1")
def lookback_count(spark: SparkSession, d: str) -> DataFrame:
    return windowed.lookback(_events(spark, d), ["event_type"], "ts", NOW, 3 * DAY, _count())


def _unique_between(spark: SparkSession, d: str, after: datetime, before: datetime) -> DataFrame:
    rows = table(spark, d, "events")
    sketches = windowed.bucket_sketches(rows, ["event_type"], "ts", HOUR, F.col("user_id"))
    said = windowed.uniques_between(sketches, ["event_type"], HOUR, after, before)
    inside = rows.where((F.col("ts") >= F.lit(after.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col("ts") < F.lit(before.isoformat(sep=" ")).cast("timestamp_ntz")))
    exact = inside.groupBy("event_type", "user_id").agg(F.lit(1)).groupBy("event_type").agg(F.count("user_id").alias("exact"))
    return said.join(exact, "event_type").select("event_type", "exact", (F.abs(F.col("uniques") - F.col("exact")) <= 2 + 0.1 * F.col("exact")).alias("within_bound"))


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS within_bound FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12 12:00:00' AND event_type IS NOT NULL GROUP BY 1")
def windowed_uniquecount(spark: SparkSession, d: str) -> DataFrame:
    return _unique_between(spark, d, FROM, UNTIL)


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS within_bound FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-20' AND event_type IS NOT NULL GROUP BY 1")
def lookback_uniquecount(spark: SparkSession, d: str) -> DataFrame:
    return _unique_between(spark, d, datetime(2024, 1, 17), NOW)


# --- streams: each is run over the table until all of it is processed


@query(_VALUES)
def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """A rollup kept from a stream of six micro-batches in mergeable states, compacted on the way, then read."""
    folder = scratch(spark)
    kept = stream_rollup.RollupTable(spark, f"{folder}/values", VALUES, compact_every=4)
    stream_rollup.keep(arriving(spark, _events(spark, d), f"{folder}/in", 6), [kept], f"{folder}/checkpoint", available_now=True).awaitTermination()
    return _rounded(kept.read())


@query(_VALUES)
def stream_live(spark: SparkSession, d: str) -> DataFrame:
    """A rollup kept in Spark's state store over four micro-batches, as it is after the last."""
    folder = scratch(spark)
    running = stream_rollup.live(arriving(spark, _events(spark, d), f"{folder}/in", 4), VALUES)
    write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/now")
    writer = running.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _rounded(spark.read.schema(running.schema).parquet(f"{folder}/now"))


def _finished(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """The rows that a streaming aggregation appends, as a table."""
    spark = stream.sparkSession
    running = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    running.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_ENDED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    f"""SELECT event_type, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start FROM events)
        WHERE window_start + INTERVAL 24 HOUR <= {_ENDED} GROUP BY 1, 2"""
)
def stream_tumbling_count(spark: SparkSession, d: str) -> DataFrame:
    """Days that the watermark has passed, appended once each."""
    counts = stream_windows.tumbling(stream_table(spark, d, "events", 4), ["event_type"], "ts", "1 day", "1 hour", {"n": F.count(F.lit(1))})
    out = _finished(counts, scratch(spark), "append")
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("window_start", "window_end")})


@query(
    f"""WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT event_type, ts, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM e)
        SELECT event_type, min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, count(*) AS n FROM s GROUP BY event_type, i HAVING max(ts) + INTERVAL 2 HOUR <= {_ENDED}"""
)
def stream_session_count(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events less than two hours apart."""
    counts = stream_windows.sessions(stream_table(spark, d, "events", 4), ["event_type"], "ts", "2 hours", "1 hour", {"n": F.count(F.lit(1))})
    out = _finished(counts, scratch(spark), "append")
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("window_start", "window_end")})


@query(
    f"""SELECT event_type, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS n
        FROM (SELECT event_type, ts, date_trunc('hour', ts)::TIMESTAMP - to_hours(((hour(ts) % 2) + 2 * k)::INTEGER) AS window_start FROM events, range(3) AS k(k))
        WHERE ts < window_start + INTERVAL 6 HOUR AND window_start + INTERVAL 6 HOUR <= {_ENDED} GROUP BY 1, 2"""
)
def stream_sliding_count(spark: SparkSession, d: str) -> DataFrame:
    """Six hours every two hours."""
    counts = stream_windows.sliding(stream_table(spark, d, "events", 4), ["event_type"], "ts", "6 hours", "2 hours", "1 hour", {"n": F.count(F.lit(1))})
    out = _finished(counts, scratch(spark), "append")
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("window_start", "window_end")})

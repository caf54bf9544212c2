"""The queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.columns import from_micros, micros
from tallyweir.operators import panes, skew
from tallyweir.registry import Registry
from tallyweir.session import scratch
from tallyweir.sources import lines
from tallyweir.sources.tables import table
from tallyweir.streaming.panes import PaneStream

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- 1: rows that fail to parse

_QUOTED = '"(?:[^"]|"")*"'
_LINES = rf"""WITH a AS (SELECT *, layout = 'csv' AS csv, regexp_replace(coalesce(line, ''), '\r$', '') AS t FROM raw_line),
    b AS (SELECT *, regexp_extract(t, '^[0-9]+') AS digits FROM a),
    c AS (SELECT *, substr(t, length(digits) + 1, 1) AS mark, substr(t, length(digits) + 1) AS rest FROM b),
    m AS (SELECT *, CASE WHEN csv THEN ',' WHEN regexp_matches(mark, '^[!-/:-@\[-`{{-~]$') THEN '\' || mark ELSE mark END AS d FROM c),
    v AS (SELECT *, CASE WHEN csv THEN '()({_QUOTED}|[^",][^",]*|)' WHEN mark = '=' THEN '([^"=]*)()' ELSE '([^"=' || d || ']*)(?:=({_QUOTED}|[^"' || d || '][^"' || d || ']*|))?' END AS item FROM m),
    f AS (SELECT *, CASE WHEN digits = '' OR length(ltrim(digits, '0')) > 16 THEN false ELSE TRY_CAST(right(digits, 18) AS BIGINT) BETWEEN 946684800000000 AND 4102444799999999 END
            AND (NOT csv OR mark IN ('', ',')) AS time_ok,
        mark = '' OR (mark <> '"' AND regexp_full_match(rest, '(?:' || d || item || ')*')) AS quoting_ok,
        CASE WHEN mark <> '' THEN regexp_extract_all(rest, d || item, 1) ELSE [] END AS names, CASE WHEN mark <> '' THEN regexp_extract_all(rest, d || item, 2) ELSE [] END AS raw FROM v),
    g AS (SELECT *, CASE WHEN csv THEN ['name', 'country', 'iata', 'height', 'tz'] ELSE names END AS fields,
        list_transform(raw, lambda x: CASE WHEN x[1] = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE coalesce(x, '') END) AS val FROM f),
    h AS (SELECT *, CASE WHEN csv THEN len(val) = 5 ELSE list_sort(names) = ['country', 'height', 'iata', 'name', 'tz'] END AS columns_ok, val[list_position(fields, 'height')] AS tall FROM g),
    l AS (SELECT *, CASE WHEN NOT time_ok THEN 'time' WHEN NOT quoting_ok THEN 'quoting' WHEN NOT columns_ok THEN 'columns'
        WHEN tall <> '' AND NOT (regexp_full_match(tall, '[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?') AND coalesce(isfinite(TRY_CAST(tall AS DOUBLE)), false)) THEN 'height' END AS reason FROM h)"""


@query(f"{_LINES} SELECT line_id, reason FROM l WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The lines that fail, each with its reason."""
    return lines.rejects(lines.parse_lines(table(spark, d, "raw_line"), ["line_id"])).select("line_id", "reason")


@query(
    _LINES
    + " SELECT line_id, receive_time, make_timestamp(right(digits, 18)::BIGINT) AS data_time, "
    + ", ".join(f"val[list_position(fields, '{f}')] AS {f}" for f in ("name", "country", "iata", "tz"))
    + ", CASE WHEN tall <> '' THEN TRY_CAST(tall AS DOUBLE) END AS height FROM l WHERE reason IS NULL"
)
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The typed Rows of all other lines."""
    return lines.loaded(lines.parse_lines(table(spark, d, "raw_line"), ["line_id", "receive_time"]))


# --- 3: a few keys holding most records

_HEAVY = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS key_value FROM observation WHERE {f} IS NOT NULL GROUP BY {f} HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM observation)"
    for f in ("country", "tz")
)


@query(_HEAVY)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The countries and zones that hold at least 4% of all rows."""
    return skew.heavy_keys(table(spark, d, "observation"), ["country", "tz"], 4).select("field", "key_value")


def _measures_sql(key: str) -> str:
    return f"""
        WITH w AS (SELECT {key} AS key, iata AS value, count(*) AS weight FROM observation GROUP BY 1, 2),
        best AS (SELECT key, value, weight, row_number() OVER (PARTITION BY key ORDER BY weight DESC, encode(value)) AS r FROM w WHERE value IS NOT NULL)
        SELECT a.key, a.n_rows, a.n_values, a.n_distinct, b.value AS mode, b.weight AS mode_rows
        FROM (SELECT key, sum(weight)::BIGINT AS n_rows, coalesce(sum(weight) FILTER (value IS NOT NULL), 0)::BIGINT AS n_values, count(value) AS n_distinct FROM w GROUP BY key) a
        LEFT JOIN best b ON b.key IS NOT DISTINCT FROM a.key AND b.r = 1"""


PERMILLE = (10, 250, 500, 750, 900, 990)


def _percentiles_sql(key: str) -> str:
    return f"""
        WITH v AS (SELECT {key} AS key, height + 0.0 AS value FROM observation WHERE height IS NOT NULL AND NOT isnan(height)),
        r AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY value) AS i, count(*) OVER (PARTITION BY key) AS n FROM v),
        p AS (SELECT unnest([{', '.join(map(str, PERMILLE))}])::INTEGER AS permille)
        SELECT r.key, p.permille, r.n, r.value FROM r JOIN p ON r.i = greatest(1, (r.n * p.permille + 999) // 1000)"""


@query(_measures_sql("country"))
def p3_country_measures(spark: SparkSession, d: str) -> DataFrame:
    return skew.measures(table(spark, d, "observation"), "country", "iata")


@query(_measures_sql("tz"))
def p3_tz_measures(spark: SparkSession, d: str) -> DataFrame:
    return skew.measures(table(spark, d, "observation"), "tz", "iata")


@query(_percentiles_sql("country"))
def p3_country_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.percentiles(table(spark, d, "observation"), "country", "height", PERMILLE)


@query(_percentiles_sql("tz"))
def p3_tz_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return skew.percentiles(table(spark, d, "observation"), "tz", "height", PERMILLE)


# --- 5: late and out-of-order events

DAILY = panes.Windows()
THREE_DAYS = panes.Windows(size=3 * panes.DAY, slide=panes.DAY)
# a value that six places do not say would be in n_inexact, and one that no decimal holds would be an error
_PARTIALS = """count(*) AS n_rows, count(v) AS n_values, sum(CAST(v AS DECIMAL(38,6)))::DOUBLE AS sum_value, count_if(v <> CAST(v AS DECIMAL(38,6))::DOUBLE)::BIGINT AS n_inexact, min(v) AS min_value, max(v) AS max_value"""
_RUNNING = """(sum(n_rows) OVER w)::BIGINT AS n_rows, (sum(n_values) OVER w)::BIGINT AS n_values, (sum(sum_value) OVER w)::DOUBLE AS sum_value,
    (sum(n_inexact) OVER w)::BIGINT AS n_inexact, min(min_value) OVER w AS min_value, max(max_value) OVER w AS max_value"""
_ROWS = """SELECT data_time, receive_time, CASE WHEN NOT isnan(height) THEN height END AS v FROM observation WHERE data_time IS NOT NULL AND receive_time IS NOT NULL"""


def _panes(spark: SparkSession, d: str, windows: panes.Windows) -> tuple[DataFrame, dict]:
    partials = panes.number_partials("height")
    return panes.pane_table(table(spark, d, "observation"), windows, [], partials), partials


@query("SELECT obs_id FROM observation WHERE receive_time >= date_trunc('day', data_time) + INTERVAL 72 HOUR")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows that came when their day was closed."""
    return panes.closed_rows(table(spark, d, "observation"), DAILY).select("obs_id")


@query(
    f"""SELECT date_trunc('day', data_time)::TIMESTAMP AS window_start, date_trunc('day', data_time)::TIMESTAMP + INTERVAL 24 HOUR AS window_end, {_PARTIALS}
        FROM ({_ROWS}) WHERE receive_time < date_trunc('day', data_time) + INTERVAL 72 HOUR GROUP BY 1, 2"""
)
def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """The aggregates of each day when it is closed."""
    state, partials = _panes(spark, d, DAILY)
    return panes.with_sums(panes.final_windows(state, DAILY, [], partials))


@query(
    f"""WITH r AS ({_ROWS}), s AS (SELECT date_trunc('day', data_time)::TIMESTAMP AS window_start, date_trunc('day', receive_time)::TIMESTAMP + INTERVAL 24 HOUR AS emitted_at, v
            FROM r WHERE receive_time < date_trunc('day', data_time) + INTERVAL 72 HOUR),
        a AS (SELECT window_start, emitted_at, {_PARTIALS.replace('::DOUBLE AS sum_value', ' AS sum_value')} FROM s GROUP BY 1, 2)
        SELECT window_start, (row_number() OVER w)::INTEGER AS revision, emitted_at, {_RUNNING}
        FROM a WINDOW w AS (PARTITION BY window_start ORDER BY emitted_at)"""
)
def p5_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Each day's aggregates as corrected after each day of arrivals that changed them."""
    state, partials = _panes(spark, d, DAILY)
    return panes.with_sums(panes.revisions(state, DAILY, [], partials))


@query(
    f"""WITH r AS ({_ROWS}), s AS (SELECT r.*, date_trunc('day', data_time)::TIMESTAMP - to_days(k::INTEGER) AS window_start FROM r, range(3) AS k(k))
        SELECT window_start, window_start + INTERVAL 72 HOUR AS window_end, {_PARTIALS} FROM s
        WHERE receive_time < window_start + INTERVAL 120 HOUR GROUP BY 1, 2"""
)
def p5_three_days(spark: SparkSession, d: str) -> DataFrame:
    """Windows of three days that begin every day, each composed of three panes."""
    state, partials = _panes(spark, d, THREE_DAYS)
    return panes.with_sums(panes.final_windows(state, THREE_DAYS, [], partials))


ARRIVALS = 5
_ARRIVALS = f"""l AS (SELECT epoch_us(min(receive_time)) AS low, (epoch_us(max(receive_time)) - epoch_us(min(receive_time))) // {ARRIVALS} + 1 AS width FROM observation)"""


def _streamed(spark: SparkSession, d: str, windows: panes.Windows) -> tuple[PaneStream, DataFrame]:
    """A stream kept from the rows as they arrive, in ``ARRIVALS`` micro-batches of equal stretches of receive time, and
    what it emitted. The query over the stream is stopped and started again between the batches."""
    partials = panes.number_partials("height")
    folder = scratch(spark)
    kept = PaneStream(spark, f"{folder}/days", windows, [], partials, compact_every=2)
    rows = table(spark, d, "observation").select("obs_id", "data_time", "receive_time", "height")
    low, high = rows.agg(F.min(micros(F.col("receive_time"))), F.max(micros(F.col("receive_time")))).first()
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // ARRIVALS + 1
    written = []
    for step in range(ARRIVALS):
        begin, end = (from_micros(F.lit(low + i * width)) for i in (step, step + 1))
        arrived = (F.col("receive_time") >= begin) & (F.col("receive_time") < end)
        arrived = arrived | F.col("receive_time").isNull() if step == 0 else arrived
        rows.where(arrived).write.mode("append").parquet(f"{folder}/arrived")

        def emit(changed: DataFrame, batch: int, step: int = step) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/emitted/step={step}")
            written.append(step)

        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrived")
        kept.start(stream, emit, f"{folder}/checkpoint", available_now=True).awaitTermination()
    return kept, spark.read.parquet(f"{folder}/emitted") if written else kept.final().withColumn("step", F.lit(0))


@query(SQL["p5_daily"])
def p5_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The days' aggregates kept from a stream of the rows in the order of their arrival."""
    return panes.with_sums(_streamed(spark, d, DAILY)[0].final())


@query(
    f"""WITH r AS ({_ROWS}), {_ARRIVALS}, s AS (SELECT date_trunc('day', data_time)::TIMESTAMP - to_days(k::INTEGER) AS window_start, ((epoch_us(receive_time) - low) // width)::INTEGER AS step, receive_time, v
            FROM r, l, range(3) AS k(k)),
        a AS (SELECT window_start, step, {_PARTIALS.replace('::DOUBLE AS sum_value', ' AS sum_value')} FROM s WHERE receive_time < window_start + INTERVAL 120 HOUR GROUP BY 1, 2)
        SELECT window_start, window_start + INTERVAL 72 HOUR AS window_end, step, {_RUNNING} FROM a WINDOW w AS (PARTITION BY window_start ORDER BY step)"""
)
def p5_emitted(spark: SparkSession, d: str) -> DataFrame:
    """What the stream emits after each micro-batch: the three-day windows that it changed, with their new aggregates."""
    return panes.with_sums(_streamed(spark, d, THREE_DAYS)[1])

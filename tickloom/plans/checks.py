"""Queries on data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.plans import inputs as I
from tickloom.plans.base_sql import BARS, DIRTY, LEVELS, TAPE, with_ctes
from tickloom.plans.inputs import DIRTY_EVENTS_SQL
from tickloom.plans.registry import query, rounded, significant
from tickloom.schemas import TIME
from tickloom.session import checkpoint_location
from tickloom.sources.sinks import write_csv
from tickloom.sources.tape import table

ON_DIRTY = with_ctes(TAPE, BARS, DIRTY)

_GAPS = """
, diffs AS (
  SELECT epoch(DateTime - lag(DateTime) OVER (PARTITION BY symbol ORDER BY DateTime)) AS step FROM {source}),
middle AS (SELECT quantile_cont(step, 0.5) AS median_s FROM diffs)
SELECT count(*) FILTER (WHERE step > median_s * 10) AS n_gaps, any_value(median_s) AS median_s,
       max(step) FILTER (WHERE step > median_s * 10) AS max_gap_s
FROM diffs, middle"""


@query("validate_schema", ON_DIRTY + """
, wanted AS (SELECT * FROM (VALUES ('Open', 'issue'), ('High', 'issue'), ('Low', 'issue'), ('Close', 'issue'),
  ('Volume', 'issue'), ('RVOL', 'warning'), ('Price', 'warning'), ('Delta', 'warning'),
  ('CumulativeDelta', 'warning')) w("column", severity)),
present AS (SELECT "column", n FROM (UNPIVOT (SELECT count("Open") AS "Open", count("High") AS "High",
  count("Low") AS "Low", count("Close") AS "Close", count("Volume") AS "Volume", count("Delta") AS "Delta"
  FROM dirty) ON COLUMNS(*) INTO NAME "column" VALUE n))
SELECT w."column", severity, p."column" IS NOT NULL AS present, CAST(coalesce(n, 0) AS BIGINT) AS n_values,
       (SELECT count(*) FROM dirty) AS n_rows FROM wanted w LEFT JOIN present p USING ("column")""")
def validate_schema(spark, sf):
    return Q.schema_check(I.dirty_bars(spark, sf))


def _null_sql(columns, source, suffix=""):
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS {suffix or 'nulls'},
        round((count(*) - count("{c}")) * 100.0 / count(*), 6) AS pct FROM {source} HAVING count(*) > count("{c}")"""
        for c in columns)


@query("validate_nulls", ON_DIRTY + _null_sql(["Open", "High", "Low", "Close", "Volume", "Delta"], "dirty"))
def validate_nulls(spark, sf):
    return rounded(Q.null_counts(I.dirty_bars(spark, sf)), 6, "pct")


_BAD_OHLC = '"High" < "Low" OR "High" < "Open" OR "High" < "Close" OR "Low" > "Open" OR "Low" > "Close"'


@query("validate_ohlc", ON_DIRTY + f"SELECT count(*) AS n_bad FROM dirty WHERE {_BAD_OHLC}")
def validate_ohlc(spark, sf):
    return Q.ohlc_check(I.dirty_bars(spark, sf))


@query("validate_volume", ON_DIRTY + 'SELECT count(*) AS n_bad FROM dirty WHERE "Volume" < 0')
def validate_volume(spark, sf):
    return Q.volume_check(I.dirty_bars(spark, sf))


@query("validate_gaps_level", with_ctes(TAPE, LEVELS) + _GAPS.format(source="levels"))
def validate_gaps_level(spark, sf):
    return Q.gap_check(I.levels(spark, sf), "level")


@query("validate_gaps_bar", with_ctes(TAPE, BARS) + _GAPS.format(source="bars"))
def validate_gaps_bar(spark, sf):
    return Q.gap_check(I.bars(spark, sf), "bar")


@query("validate_gaps_trades", "WITH trades AS (SELECT event_type AS symbol, ts + to_microseconds(event_id % 7 * 130000) "
       "AS DateTime FROM events)" + _GAPS.format(source="trades"))
def validate_gaps_trades(spark, sf):
    """Times between seconds, one row a trade: every row is a step."""
    moved = F.expr("ts + make_dt_interval(0, 0, 0, CAST(event_id % 7 * 0.13 AS DECIMAL(18, 6)))")
    trades = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), moved.alias("DateTime"))
    return Q.gap_check(trades, "level", chunk=F.date_trunc("hour", "DateTime"))


_OUTLIERS = """
, stats AS (SELECT avg({c}) AS mean, stddev_samp({c}) AS std FROM {t})
SELECT count(*) FILTER (WHERE {c} > mean + {k} * std OR {c} < mean - {k} * std) AS n,
       CAST(printf('%.8e', any_value(mean)) AS DOUBLE) AS mean, CAST(printf('%.8e', any_value(std)) AS DOUBLE) AS std
FROM {t}, stats"""


@query("validate_outliers", with_ctes(TAPE, BARS) + _OUTLIERS.format(c="close", t="bars", k=5))
def validate_outliers(spark, sf):
    return significant(Q.outlier_check(I.bars(spark, sf)), "mean", "std")


@query("validate_outliers_lineitem",
       "WITH x AS (SELECT 1)" + _OUTLIERS.format(c="l_extendedprice", t="lineitem", k=1.5))
def validate_outliers_lineitem(spark, sf):
    found = Q.outlier_check(table(spark, sf, "lineitem"), "l_extendedprice", 1.5)
    return significant(found, "mean", "std")


_FINDINGS = f"""
, diffs AS (SELECT epoch(DateTime - lag(DateTime) OVER (PARTITION BY symbol ORDER BY DateTime)) AS step FROM dirty),
stats AS (SELECT avg("Close") AS mean, stddev_samp("Close") AS std FROM dirty),
findings AS (
  SELECT 'optional_columns' AS "check", 'warning' AS severity, c AS "column", 1 AS n, CAST(NULL AS DOUBLE) AS pct,
         CAST(NULL AS VARCHAR) AS detail
  FROM (VALUES ('RVOL'), ('Price'), ('CumulativeDelta')) v(c)
  UNION ALL SELECT 'nulls', 'warning', 'Close', count(*) - count("Close"),
            round((count(*) - count("Close")) * CAST(100 AS DOUBLE) / count(*), 6), NULL FROM dirty
  UNION ALL SELECT 'nulls', 'warning', 'Delta', count(*) - count("Delta"),
            round((count(*) - count("Delta")) * CAST(100 AS DOUBLE) / count(*), 6), NULL FROM dirty
  UNION ALL SELECT 'ohlc', 'issue', NULL, count(*), NULL, NULL FROM dirty WHERE {_BAD_OHLC}
  UNION ALL SELECT 'volume', 'issue', 'Volume', count(*), NULL, NULL FROM dirty WHERE "Volume" < 0
  UNION ALL SELECT 'gaps', 'warning', 'DateTime', count(*), NULL,
            (SELECT printf('median %g s, largest %g s', quantile_cont(step, 0.5), max(step)) FROM diffs) FROM diffs
            WHERE step > 10 * (SELECT quantile_cont(step, 0.5) FROM diffs)
  UNION ALL SELECT 'outliers', 'warning', 'Close', count(*), NULL, NULL FROM dirty, stats
            WHERE "Close" > mean + 5 * std OR "Close" < mean - 5 * std)"""


@query("validate_report", ON_DIRTY + _FINDINGS + """
SELECT "check", severity, "column", CAST(n AS BIGINT) AS n, pct, detail FROM findings WHERE n > 0""")
def validate_report(spark, sf):
    return rounded(Q.report(I.dirty_bars(spark, sf)), 6, "pct")


@query("validate_csv", ON_DIRTY + _FINDINGS + """
SELECT "check", severity, "column", CAST(n AS BIGINT) AS n, pct, detail FROM findings WHERE n > 0
UNION ALL SELECT 'table', 'info', NULL, count(*), NULL,
                 '8 columns, ' || CAST(min(DateTime) AS VARCHAR) || ' to ' || CAST(max(DateTime) AS VARCHAR) FROM dirty""")
def validate_csv(spark, sf):
    """Bars written as CSV, read back and judged in one call."""
    bars = I.dirty_bars(spark, sf)
    path = write_csv(bars.select(TIME, *[c for c in bars.columns if c != TIME]), checkpoint_location(spark))
    return rounded(Q.validate_path(spark, path)[0], 6, "pct")


@query("validate_duplicates", with_ctes(DIRTY_EVENTS_SQL) + """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicate_rows
FROM (SELECT event_id, ts, count(*) AS n FROM dirty_events GROUP BY 1, 2)""")
def validate_duplicates(spark, sf):
    return Q.duplicate_keys(I.dirty_events(spark, sf), ["event_id", "ts"])


@query("validate_monotonic", """
WITH late AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL '2 hours' ELSE ts END AS ts FROM events)
SELECT count(*) FILTER (WHERE back) AS n_backward_steps
FROM (SELECT ts < lag(ts) OVER (ORDER BY event_id) AS back FROM late)""")
def validate_monotonic(spark, sf):
    late = table(spark, sf, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL '2' HOUR ELSE ts END").alias("ts"))
    return Q.backward_steps(late, "event_id", "ts", block=4096)



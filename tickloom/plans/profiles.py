"""Queries that profile columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tickloom.operators import profile as P
from tickloom.operators import sketches as S
from tickloom.plans import inputs as I
from tickloom.plans.base_sql import BARS, TAPE, with_ctes
from tickloom.plans.inputs import DIRTY_EVENTS_SQL, LINEITEM_NUMBERS
from tickloom.plans.registry import query, rounded, significant
from tickloom.session import stage
from tickloom.sources.tape import table, tape

ON_DIRTY = with_ctes(DIRTY_EVENTS_SQL)
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def _each(columns, template, source="lineitem"):
    return "\nUNION ALL\n".join(template.format(c=c, t=source) for c in columns)


def _sig(expr, name):
    return f"CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE) AS {name}"


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


# -- missing, shape, uniqueness --------------------------------------------------------------

@query("eda_missing", ON_DIRTY + _each(EVENT_COLUMNS, """SELECT '{c}' AS "column", count(*) - count({c}) AS n,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct FROM {t} HAVING count(*) > count({c})""",
                                       "dirty_events"))
def eda_missing(spark, sf):
    return rounded(P.missing(I.dirty_events(spark, sf)), 6, "pct")


@query("eda_missing_totals", ON_DIRTY + """
, flagged AS (SELECT (user_id IS NULL)::INT + (event_type IS NULL)::INT + (value IS NULL)::INT AS gaps FROM dirty_events)
SELECT CAST(sum(gaps) AS BIGINT) AS total,
       round((1 - count(*) FILTER (WHERE gaps > 0) / count(*)) * 100, 6) AS complete_pct,
       round(sum(gaps) * 100.0 / (count(*) * 6), 6) AS overall_pct FROM flagged""")
def eda_missing_totals(spark, sf):
    return rounded(P.missing_totals(I.dirty_events(spark, sf)), 6, "complete_pct", "overall_pct")


@query("eda_overview", """
SELECT (SELECT count(*) FROM lineitem) AS rows, count(*) AS columns,
       count(*) FILTER (WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')) AS numeric_columns,
       count(*) FILTER (WHERE column_type = 'VARCHAR') AS text_columns,
       count(*) FILTER (WHERE column_type = 'TIMESTAMP') AS time_columns
FROM (DESCRIBE lineitem)""")
def eda_overview(spark, sf):
    return P.overview(lineitem(spark, sf))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice",
                 "o_orderpriority"]


@query("eda_uniqueness", _each(ORDER_COLUMNS, """SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique,
  round(count(DISTINCT {c}) / count(*), 6) AS ratio, CASE any_value(typeof({c})) WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(any_value(typeof({c}))) END AS dtype FROM {t}""", "orders"))
def eda_uniqueness(spark, sf):
    return rounded(P.uniqueness(table(spark, sf, "orders"), ORDER_COLUMNS), 6, "ratio")


@query("eda_categorical", _each(["o_orderstatus", "o_orderpriority"], """
SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
  (SELECT count(DISTINCT {c}) FROM {t}) AS n_unique FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}
  ORDER BY n DESC, value LIMIT 5)""", "orders"))
def eda_categorical(spark, sf):
    return P.categorical(table(spark, sf, "orders")).select("column", "value", "n", "n_unique")


@query("eda_duplicates", ON_DIRTY + """
SELECT CAST(sum(n) - count(*) AS BIGINT) AS n, round((sum(n) - count(*)) * 100.0 / sum(n), 6) AS pct
FROM (SELECT count(*) AS n FROM dirty_events GROUP BY event_id, ts, user_id, event_type, value, props)""")
def eda_duplicates(spark, sf):
    return rounded(P.duplicates(I.dirty_events(spark, sf)), 6, "pct")


# -- moments and quantiles -------------------------------------------------------------------

@query("eda_describe", _each(LINEITEM_NUMBERS, """SELECT '{c}' AS "column", count({c}) AS count,
  """ + _sig("avg({c})", "mean") + ", " + _sig("stddev_samp({c})", "std") + """, min({c}) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM {t}"""))
def eda_describe(spark, sf):
    described = P.describe(lineitem(spark, sf), LINEITEM_NUMBERS)
    return significant(rounded(described, 6, "q25", "q50", "q75"), "mean", "std")


@query("eda_moments", _each(LINEITEM_NUMBERS, """SELECT '{c}' AS "column", round(skewness({c}), 6) AS skewness,
  round(kurtosis({c}), 6) AS kurtosis, """ + _sig("var_samp({c})", "variance") + ", "
                            + _sig("stddev_samp({c})", "std") + ", " + _sig("max({c}) - min({c})", "range")
                            + " FROM {t}"))
def eda_moments(spark, sf):
    made = rounded(P.moments(lineitem(spark, sf), LINEITEM_NUMBERS), 6, "skewness", "kurtosis")
    return significant(made, "variance", "std", "range")


def _quantile_sql(names, columns=LINEITEM_NUMBERS, source="lineitem", extra=""):
    parts = ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in names.items())
    return _each(columns, f"""SELECT '{{c}}' AS "column", {extra}{parts} FROM {{t}}""", source)


QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


@query("eda_quantiles", _quantile_sql(QUANTILES))
def eda_quantiles(spark, sf):
    return rounded(P.quantiles(lineitem(spark, sf), LINEITEM_NUMBERS), 6, *QUANTILES)


@query("eda_extremes", _quantile_sql({"p1": 0.01, "p99": 0.99}, extra="min({c}) AS min, max({c}) AS max, "))
def eda_extremes(spark, sf):
    return rounded(P.extremes(lineitem(spark, sf), LINEITEM_NUMBERS), 6, "p1", "p99")


_SHAPE = """
SELECT '{c}' AS "column", round(skewness({c}), 6) AS skewness,
  CASE WHEN abs(skewness({c})) < 0.5 THEN 'Approximately Normal' WHEN skewness({c}) > 0.5 THEN 'Right Skewed'
       ELSE 'Left Skewed' END AS skew_label,
  round(kurtosis({c}), 6) AS kurtosis,
  CASE WHEN kurtosis({c}) > 3 THEN 'Heavy Tailed' WHEN kurtosis({c}) < -1 THEN 'Light Tailed'
       ELSE 'Normal Tails' END AS tail_label,
  count(*) FILTER (WHERE {c} = 0) AS zeros,
  round(count(*) FILTER (WHERE {c} = 0) * 100.0 / count(*), 6) AS zeros_pct FROM {t}"""


@query("eda_shape", _each(LINEITEM_NUMBERS, _SHAPE) + "\nUNION ALL\n" + _each(["value"], _SHAPE, "events"))
def eda_shape(spark, sf):
    both = P.shape(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(P.shape(table(spark, sf, "events"), ["value"]))
    return rounded(both, 6, "skewness", "kurtosis", "zeros_pct")


_FLAGS = """SELECT '{c}' AS "column", var_samp({c}) > avg({c}) AS high_var, abs(skewness({c})) > 1 AS skewed,
  var_samp({c}) = 0 AS constant FROM {t}"""


@query("eda_feature_flags", _each(LINEITEM_NUMBERS, _FLAGS) + "\nUNION ALL\n" + _each(["value"], _FLAGS, "events"))
def eda_feature_flags(spark, sf):
    return P.feature_flags(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.feature_flags(table(spark, sf, "events"), ["value"]))


# -- distributions ---------------------------------------------------------------------------

_HISTOGRAM = """
SELECT '{c}' AS "column", g.bin, round(lo + g.bin * ((hi - lo) / 50), 6) AS lo,
       round(lo + (g.bin + 1) * ((hi - lo) / 50), 6) AS hi, coalesce(n, 0) AS n,
       CAST(printf('%.8e', coalesce(n, 0) / total / ((hi - lo) / 50)) AS DOUBLE) AS density
FROM (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS total FROM {t}) e
CROSS JOIN (SELECT range AS bin FROM range(50)) g
LEFT JOIN (SELECT least(CAST(floor(({c} - m) / (x - m) * 50) AS BIGINT), 49) AS bin, count(*) AS n
           FROM {t}, (SELECT min({c}) AS m, max({c}) AS x FROM {t}) GROUP BY 1) h ON h.bin = g.bin"""


@query("eda_histogram", _each(LINEITEM_NUMBERS, _HISTOGRAM) + "\nUNION ALL\n"
       + _each(["value"], _HISTOGRAM, "events"))
def eda_histogram(spark, sf):
    both = P.histogram(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.histogram(table(spark, sf, "events"), ["value"]))
    return significant(rounded(both, 6, "lo", "hi"), "density")


_BOX = """
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1)) AS whisker_lo,
       max({c}) FILTER (WHERE {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_fliers
FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3
           FROM {t}) GROUP BY q1, med, q3"""


@query("eda_boxplot", _each(LINEITEM_NUMBERS, _BOX) + "\nUNION ALL\n" + _each(["value"], _BOX, "events"))
def eda_boxplot(spark, sf):
    both = P.boxplot(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.boxplot(table(spark, sf, "events"), ["value"]))
    return rounded(both, 6, "q1", "median", "q3")


@query("eda_normal_curve", """
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS s, min(value) AS lo, max(value) AS hi FROM events),
x AS (SELECT m, s, lo + range * ((hi - lo) / 99) AS x FROM s, range(100))
SELECT round(x, 6) AS x, CAST(printf('%.6e', exp(-0.5 * ((x - m) / s) * ((x - m) / s)) / (s * sqrt(2 * pi()))) AS DOUBLE)
  AS pdf FROM x""")
def eda_normal_curve(spark, sf):
    curve = P.normal_curve(table(spark, sf, "events"), "value")
    return significant(rounded(curve, 6, "x"), "pdf", digits=6)


_GRID = [(i + 1) / 100 for i in range(99)]


def _list(values):
    return "[" + ", ".join(f"CAST('{v!r}' AS DOUBLE)" for v in values) + "]"


@query("eda_qq", f"""
SELECT unnest({_list(_GRID)}) AS p, round(unnest(quantile_cont(value, {_list(_GRID)})), 6) AS sample_q,
       round(unnest({_list([NormalDist().inv_cdf(p) for p in _GRID])}), 6) AS normal_q
FROM (SELECT value FROM events)""")
def eda_qq(spark, sf):
    return rounded(P.qq(table(spark, sf, "events"), "value"), 6, "sample_q", "normal_q")


# -- relations -------------------------------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(LINEITEM_NUMBERS) for b in LINEITEM_NUMBERS[i + 1:]]


@query("eda_corr", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS))
def eda_corr(spark, sf):
    return rounded(P.correlation(lineitem(spark, sf), LINEITEM_NUMBERS), 6, "r")


_BAR_PRICES = ["Open", "High", "Low", "Close", "Volume", "Trades"]
_BAR_PAIRS = [(a, b) for i, a in enumerate(_BAR_PRICES) for b in _BAR_PRICES[i + 1:]]


@query("eda_corr_high", with_ctes(TAPE, BARS) + """
SELECT * FROM (""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM bars" for a, b in _BAR_PAIRS)
       + ") WHERE abs(r) > 0.7")
def eda_corr_high(spark, sf):
    return rounded(P.high_correlation(I.bars(spark, sf), _BAR_PRICES), 6, "r")


@query("eda_pairs", f"SELECT {', '.join(LINEITEM_NUMBERS)} FROM lineitem WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in LINEITEM_NUMBERS))
def eda_pairs(spark, sf):
    return P.pairs(lineitem(spark, sf), LINEITEM_NUMBERS)


@query("eda_price_volume", """
SELECT 'l_extendedprice' AS price_column, CAST(l_extendedprice AS DOUBLE) AS price, 'l_quantity' AS volume_column,
       CAST(l_quantity AS DOUBLE) AS volume FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL""")
def eda_price_volume(spark, sf):
    return P.price_volume(lineitem(spark, sf))


@query("profile_from_sketches", with_ctes(TAPE) + """
, days AS (SELECT * FROM tape WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-23'),
top AS (SELECT symbol, max(n) AS top_count FROM (SELECT symbol, price, count(*) AS n FROM days GROUP BY 1, 2) GROUP BY 1)
SELECT symbol, count(*) AS n, min(price) AS lo, max(price) AS hi, any_value(top_count) AS top_count,
       true AS quantiles_hold, true AS distinct_holds
FROM days JOIN top USING (symbol) GROUP BY 1""")
def profile_from_sketches(spark, sf):
    """Sketches of all days, stored once; a range of days is merged and held against its exact ranks and distinct values."""
    points = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    stored = stage(S.daily_sketches(tape(spark, sf), "price", "ts"), "sketches")
    inside = (F.col(S.DAY) >= "2024-01-08") & (F.col(S.DAY) < "2024-01-23")
    estimated = S.profile(S.merged(stored.filter(inside)), points)
    rows = tape(spark, sf).withColumn(S.DAY, F.to_date("ts")).filter(inside).groupBy("symbol", "price").agg(F.count(F.lit(1)).alias("m"))
    judged = rows.join(estimated, "symbol").groupBy("symbol", "n", "min", "max", "quantiles", "distinct", "frequent").agg(
        F.count(F.lit(1)).alias("values"),
        *[F.sum(F.when(F.col("price") < F.col("quantiles")[i], F.col("m")).otherwise(0)).alias(f"below{i}") for i in range(len(points))],
        *[F.sum(F.when(F.col("price") <= F.col("quantiles")[i], F.col("m")).otherwise(0)).alias(f"upto{i}") for i in range(len(points))])
    holds = F.lit(True)
    for i, p in enumerate(points):
        holds = holds & (F.col(f"below{i}") / F.col("n") <= p + S.RANK_ERROR) & (F.col(f"upto{i}") / F.col("n") >= p - S.RANK_ERROR)
    return judged.select(
        "symbol", "n", F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("frequent")[0]["count"].alias("top_count"),
        holds.alias("quantiles_hold"),
        (F.abs(F.col("distinct") - F.col("values")) <= S.DISTINCT_ERROR * F.col("values")).alias("distinct_holds"))


@query("eda_timeseries", "SELECT o_orderdate AS t, o_totalprice AS v FROM orders")
def eda_timeseries(spark, sf):
    return P.timeseries(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


# -- outliers --------------------------------------------------------------------------------

_IQR = """
SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value
FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t})
WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"""

_Z = """
SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value, round(abs({c} - m) / s, 6) AS z
FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {t}) WHERE abs({c} - m) / s > 3"""


@query("eda_outliers_iqr", _each(LINEITEM_NUMBERS, _IQR) + "\nUNION ALL\n" + _each(["value"], _IQR, "events"))
def eda_outliers_iqr(spark, sf):
    return P.iqr_outliers(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.iqr_outliers(table(spark, sf, "events"), ["value"]))


@query("eda_outliers_z", _each(LINEITEM_NUMBERS, _Z) + "\nUNION ALL\n" + _each(["value"], _Z, "events"))
def eda_outliers_z(spark, sf):
    return rounded(P.z_outliers(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.z_outliers(table(spark, sf, "events"), ["value"])), 6, "z")


_SUMMARY = """
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS iqr_n,
       round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) * 100.0 / count(*), 6) AS iqr_pct,
       count(*) FILTER (WHERE abs({c} - m) / s > 3) AS z_n,
       round(count(*) FILTER (WHERE abs({c} - m) / s > 3) * 100.0 / count(*), 6) AS z_pct,
       round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper
FROM {t}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s,
    quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
    quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t})"""


@query("eda_outlier_summary", _each(LINEITEM_NUMBERS, _SUMMARY) + "\nUNION ALL\n"
       + _each(["value"], _SUMMARY, "events"))
def eda_outlier_summary(spark, sf):
    both = P.outlier_summary(lineitem(spark, sf), LINEITEM_NUMBERS).unionByName(
        P.outlier_summary(table(spark, sf, "events"), ["value"]))
    return rounded(both, 6, "iqr_pct", "z_pct", "lower", "upper")

"""Queries on profile and order-flow features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.plans import inputs as I
from tickloom.plans.base_sql import BARS, DAILY_LEVELS, DIRTY, LEVELS, STUDIES, TAPE, TAPE_DAILY, with_ctes
from tickloom.plans.registry import query, result, rounded

ON_BARS = with_ctes(TAPE, BARS)
ON_STUDIES = with_ctes(TAPE, BARS, STUDIES)
ON_DAILY = with_ctes(TAPE_DAILY, DAILY_LEVELS)


def cumulative(spark, sf):
    return B.with_cumulative_delta(I.bars(spark, sf))


# -- profile of a bar ------------------------------------------------------------------------

@query("poc", ON_DAILY + "SELECT symbol, DateTime, arg_max(price, (total_volume, -price)) AS poc_price "
       "FROM daily_levels GROUP BY 1, 2")
def poc(spark, sf):
    return result(X.point_of_control(I.daily_levels(spark, sf)), "symbol", "DateTime", "PocPrice")


@query("value_area", ON_DAILY + """
, ranked AS (
  SELECT *, sum(total_volume) OVER (PARTITION BY symbol, DateTime ORDER BY total_volume DESC, price
                                    ROWS UNBOUNDED PRECEDING) - total_volume AS before,
         sum(total_volume) OVER (PARTITION BY symbol, DateTime) AS total
  FROM daily_levels)
SELECT symbol, DateTime, min(price) AS va_low, max(price) AS va_high, CAST(sum(total_volume) AS BIGINT) AS va_volume
FROM ranked WHERE before < total * CAST(0.7 AS DOUBLE) GROUP BY 1, 2""")
def value_area(spark, sf):
    return result(X.value_area(I.daily_levels(spark, sf)), "symbol", "DateTime", "VaLow", "VaHigh", "VaVolume")


@query("volume_share", ON_DAILY + """
SELECT symbol, DateTime, price, round(total_volume / sum(total_volume) OVER (PARTITION BY symbol, DateTime), 6) AS share
FROM daily_levels""")
def volume_share(spark, sf):
    shares = X.volume_share(I.daily_levels(spark, sf))
    return rounded(result(shares, "symbol", "DateTime", "Price", "Share"), 6, "share")


@query("developing_poc", with_ctes(TAPE, BARS, LEVELS) + """
, grown AS (
  SELECT b.symbol, b.DateTime, l.price, sum(l.total_volume) AS volume
  FROM bars b JOIN levels l ON l.symbol = b.symbol AND l.DateTime <= b.DateTime
       AND CAST(l.DateTime AS DATE) = CAST(b.DateTime AS DATE)
  GROUP BY 1, 2, 3)
SELECT symbol, DateTime, arg_max(price, (volume, -price)) AS poc_price, CAST(max(volume) AS BIGINT) AS poc_volume
FROM grown GROUP BY 1, 2""")
def developing_poc(spark, sf):
    return result(X.developing_poc(I.levels(spark, sf)), "symbol", "DateTime", "PocPrice", F.col("PocVolume").alias("poc_volume"))


# -- signals ---------------------------------------------------------------------------------

@query("delta_divergence", ON_STUDIES + """
, past AS (SELECT *, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(cumulative_delta) OVER w AS c
           FROM studies WINDOW w AS (PARTITION BY symbol ORDER BY DateTime))
SELECT symbol, DateTime, CASE WHEN high > h AND cumulative_delta < c THEN 'potential_reversal_down'
  WHEN low < l AND cumulative_delta > c THEN 'potential_reversal_up' ELSE 'none' END AS signal FROM past""")
def delta_divergence(spark, sf):
    return X.delta_divergence(cumulative(spark, sf), "index")


@query("institutional_flow", ON_BARS + """
SELECT symbol, DateTime, CASE WHEN large_ask > large_bid * 1.5 AND delta > 0 THEN 'smart_money_accumulation'
  WHEN large_bid > large_ask * 1.5 AND delta < 0 THEN 'smart_money_distribution' ELSE 'none' END AS signal
FROM bars""")
def institutional_flow(spark, sf):
    return X.institutional_flow(I.bars(spark, sf))


@query("accumulation", ON_BARS + """
SELECT symbol, DateTime, CASE WHEN high - low < 10 AND delta > 50 THEN 'accumulation' ELSE 'none' END AS signal
FROM bars""")
def accumulation(spark, sf):
    return X.accumulation(I.bars(spark, sf), max_range=10, min_delta=50)


@query("breakout", ON_STUDIES + """
, past AS (
  SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY DateTime ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top,
         lag(cumulative_delta) OVER (PARTITION BY symbol ORDER BY DateTime) AS c FROM studies)
SELECT symbol, DateTime, CASE WHEN close > top AND cumulative_delta > c AND delta > 20 THEN 'strong_breakout'
  ELSE 'none' END AS signal FROM past""")
def breakout(spark, sf):
    return X.breakout(cumulative(spark, sf), 20, 20, "index")


@query("delta_alert", ON_STUDIES + """
SELECT symbol, DateTime, delta, volume FROM studies WHERE abs(delta) > 0.5 * (volume / mean_volume_20) * mean_volume_20""")
def delta_alert(spark, sf):
    # Trades have one side here, so |delta| never reaches twice the volume: the factor is lower.
    return result(X.delta_alert(I.bars(spark, sf), 20, 0.5), "symbol", "DateTime", "Delta", "Volume")


# A run is a stretch of bars in one state: 0 and NULL deltas, and bars without large trades, go on with the state before.
_RUNS = """
, stated AS (SELECT *, last_value({state} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY DateTime
                                  ROWS UNBOUNDED PRECEDING) AS state FROM bars),
turns AS (SELECT *, state IS DISTINCT FROM lag(state) OVER (PARTITION BY symbol ORDER BY DateTime) AS turn FROM stated
          WHERE state IS NOT NULL),
runs AS (SELECT *, sum(CAST(turn AS INT)) OVER (PARTITION BY symbol ORDER BY DateTime ROWS UNBOUNDED PRECEDING) AS run
         FROM turns)
"""


@query("delta_trend_reversal", ON_BARS + _RUNS.format(state="nullif(sign(delta), 0)") + """
, ended AS (SELECT symbol, run, min(DateTime) AS DateTime, any_value(state) AS state, count(*) AS bars,
                   CAST(sum(delta) AS BIGINT) AS move FROM runs GROUP BY 1, 2)
SELECT a.symbol, a.DateTime, CASE WHEN a.state > 0 THEN 'up' ELSE 'down' END AS direction, b.bars, b.move
FROM ended a JOIN ended b ON b.symbol = a.symbol AND b.run = a.run - 1 WHERE b.bars >= 3""")
def delta_trend_reversal(spark, sf):
    return X.delta_trend_reversal(I.bars(spark, sf), 3)


@query("large_trade_alert", ON_BARS + _RUNS.format(state="""CASE WHEN large_bid = 0 AND large_ask = 0 THEN NULL
  WHEN large_ask > large_bid * 1.5 THEN 1 WHEN large_bid > large_ask * 1.5 THEN -1 ELSE 0 END""") + """
, placed AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY DateTime) AS place FROM runs)
SELECT symbol, DateTime, CASE WHEN state > 0 THEN 'accumulation' ELSE 'distribution' END AS signal
FROM placed WHERE place = 3 AND state <> 0""")
def large_trade_alert(spark, sf):
    return X.large_trade_alert(I.bars(spark, sf), 1.5, 3)


# -- delta transforms ------------------------------------------------------------------------

@query("delta_ratio", ON_BARS + "SELECT symbol, DateTime, round(delta / nullif(volume, 0), 6) AS value FROM bars")
def delta_ratio(spark, sf):
    return rounded(X.delta_ratio(I.bars(spark, sf)), 6, "value")


@query("delta_slope", ON_STUDIES + """
SELECT symbol, DateTime, CASE WHEN count(*) OVER w = 5 THEN round(regr_slope(cumulative_delta, bar_index) OVER w, 6) END
  AS value FROM studies
WINDOW w AS (PARTITION BY symbol ORDER BY DateTime ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def delta_slope(spark, sf):
    return rounded(X.delta_slope(cumulative(spark, sf), position="index"), 6, "value")


@query("delta_ema", ON_STUDIES + """
SELECT s.symbol, s.DateTime,
       round(sum(p.delta * power(CAST(9 AS DOUBLE) / 11, s.bar_index - p.bar_index))
             / sum(power(CAST(9 AS DOUBLE) / 11, s.bar_index - p.bar_index)), 6) AS value
FROM studies s JOIN studies p ON p.symbol = s.symbol AND p.bar_index <= s.bar_index
GROUP BY 1, 2""")
def delta_ema(spark, sf):
    return rounded(X.delta_ema(I.bars(spark, sf)), 6, "value")


@query("delta_ema_500", with_ctes(TAPE, BARS, DIRTY) + """
, placed AS (SELECT symbol, DateTime, "Delta" AS delta, row_number() OVER (PARTITION BY symbol ORDER BY DateTime) AS bar_index FROM dirty)
SELECT s.symbol, s.DateTime,
       round(sum(p.delta * power(CAST(499 AS DOUBLE) / 501, s.bar_index - p.bar_index))
             / sum(CASE WHEN p.delta IS NOT NULL THEN power(CAST(499 AS DOUBLE) / 501, s.bar_index - p.bar_index) END), 6) AS value
FROM placed s JOIN placed p ON p.symbol = s.symbol AND p.bar_index <= s.bar_index
GROUP BY 1, 2""")
def delta_ema_500(spark, sf):
    """Some bars have no delta: they weigh nothing."""
    return rounded(X.delta_ema(I.dirty_bars(spark, sf), 500), 6, "value")


@query("delta_roc", ON_BARS + """
SELECT symbol, DateTime, delta - lag(delta) OVER (PARTITION BY symbol ORDER BY DateTime) AS value FROM bars""")
def delta_roc(spark, sf):
    return X.delta_change(I.bars(spark, sf))


@query("session_delta", ON_BARS + """
SELECT symbol, DateTime, CAST(sum(delta) OVER (PARTITION BY symbol, CAST(DateTime AS DATE) ORDER BY DateTime
                                               ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value FROM bars""")
def session_delta(spark, sf):
    return result(B.with_session_delta(I.bars(spark, sf)), "symbol", "DateTime", "SessionDelta")


_RANKED = ON_BARS + """
, ranked AS (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY delta) AS pr FROM bars)
"""


@query("delta_percentile", _RANKED + "SELECT symbol, DateTime, round(pr, 6) AS value FROM ranked")
def delta_percentile(spark, sf):
    return rounded(X.delta_percentile(I.bars(spark, sf)), 6, "value")


@query("delta_reversal", _RANKED + """
SELECT symbol, DateTime, CASE WHEN pr >= 1 - 0.05 THEN 'buying_exhausted' WHEN pr <= 0.05 THEN 'selling_exhausted'
  ELSE 'none' END AS value FROM ranked""")
def delta_reversal(spark, sf):
    return X.delta_reversal(I.bars(spark, sf)).select("symbol", "DateTime", F.col("value"))


# -- time frames -----------------------------------------------------------------------------

@query("multi_timeframe", ON_BARS + """
, hours AS (SELECT symbol, date_trunc('hour', DateTime) AS start, arg_min(open, DateTime) AS open, max(high) AS high, min(low) AS low,
                   arg_max(close, DateTime) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(delta) AS BIGINT) AS delta
            FROM bars GROUP BY 1, 2),
days AS (SELECT symbol, date_trunc('day', DateTime)::TIMESTAMP AS start, arg_min(open, DateTime) AS open, max(high) AS high, min(low) AS low,
                arg_max(close, DateTime) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(delta) AS BIGINT) AS delta
         FROM bars GROUP BY 1, 2),
with_hour AS (
  SELECT b.symbol, b.DateTime, b.close, h.start AS hour_start, h.open AS hour_open, h.high AS hour_high, h.low AS hour_low,
         h.close AS hour_close, h.volume AS hour_volume, h.delta AS hour_delta
  FROM bars b ASOF LEFT JOIN hours h ON b.symbol = h.symbol AND b.DateTime >= h.start + INTERVAL 1 HOUR)
SELECT w.*, d.start AS day_start, d.open AS day_open, d.high AS day_high, d.low AS day_low,
       d.close AS day_close, d.volume AS day_volume, d.delta AS day_delta
FROM with_hour w ASOF LEFT JOIN days d ON w.symbol = d.symbol AND w.DateTime >= d.start + INTERVAL 1 DAY""")
def multi_timeframe(spark, sf):
    joined = B.multi_timeframe(I.bars(spark, sf).select("symbol", "DateTime", "Open", "High", "Low", "Close", "Volume", "Delta"))
    parts = ["Start", "Open", "High", "Low", "Close", "Volume", "Delta"]
    return joined.select("symbol", "DateTime", F.col("Close").alias("close"), *[
        F.col(f + c).alias(f"{f}_{c}".lower()) for f in ("Hour", "Day") for c in parts])

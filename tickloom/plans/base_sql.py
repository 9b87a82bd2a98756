"""SQL text shared by the checks: tapes, bars, levels and studies as CTEs."""

TAPE = """
tape AS (
  SELECT 'S' || (user_id % 4) AS symbol, ts, event_id AS trade_id,
         floor(value / 5 + 0.5) * 5 AS price,
         CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS size,
         CASE WHEN event_type IN ('click', 'view') THEN 'bid' ELSE 'ask' END AS side
  FROM events
)"""

TAPE_DAILY = """
tape_daily AS (
  SELECT 'P' || (l_suppkey % 4) AS symbol, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         floor(l_extendedprice / l_quantity / 1000 + 0.5) * 1000 AS price,
         CAST(l_quantity AS BIGINT) AS size,
         CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side
  FROM lineitem
)"""


def bars_cte(name="bars", tape="tape", width="15 minutes", order="(ts, trade_id)", large=90):
    return f"""
{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS DateTime,
         arg_min(price, {order}) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, {order}) AS close,
         CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades,
         CAST(sum(CASE WHEN side = 'ask' THEN size ELSE -size END) AS BIGINT) AS delta,
         CAST(coalesce(max(CASE WHEN size >= {large} THEN size END), 0) AS BIGINT) AS lt_max_vol,
         CAST(coalesce(sum(CASE WHEN size >= {large} THEN size END), 0) AS BIGINT) AS lt_total_vol,
         CAST(coalesce(sum(CASE WHEN size >= {large} AND side = 'bid' THEN size END), 0) AS BIGINT) AS large_bid,
         CAST(coalesce(sum(CASE WHEN size >= {large} AND side = 'ask' THEN size END), 0) AS BIGINT) AS large_ask
  FROM {tape} GROUP BY 1, 2
)"""


def levels_cte(name="levels", tape="tape", width="15 minutes"):
    return f"""
{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{width}', ts) AS DateTime, price,
         CAST(sum(CASE WHEN side = 'bid' THEN size ELSE 0 END) AS BIGINT) AS bid_vol,
         CAST(sum(CASE WHEN side = 'ask' THEN size ELSE 0 END) AS BIGINT) AS ask_vol,
         CAST(sum(size) AS BIGINT) AS total_volume, count(*) AS num_trades
  FROM {tape} GROUP BY 1, 2, 3
)"""


BARS = bars_cte()
LEVELS = levels_cte()
DAILY_LEVELS = levels_cte("daily_levels", "tape_daily", "1 day")

STUDIES = """
studies AS (
  SELECT *,
         CAST(sum(delta) OVER (PARTITION BY symbol ORDER BY DateTime ROWS UNBOUNDED PRECEDING) AS BIGINT)
           AS cumulative_delta,
         volume / avg(volume) OVER (PARTITION BY symbol ORDER BY DateTime
                                    ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS rvol,
         avg(volume) OVER (PARTITION BY symbol ORDER BY DateTime
                           ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS mean_volume_20,
         first_value(open) OVER d AS today_open, max(high) OVER d AS today_high, min(low) OVER d AS today_low,
         row_number() OVER (PARTITION BY symbol ORDER BY DateTime) - 1 AS bar_index,
         DateTime < max(DateTime) OVER (PARTITION BY symbol) AS is_closed
  FROM bars
  WINDOW d AS (PARTITION BY symbol, CAST(DateTime AS DATE) ORDER BY DateTime ROWS UNBOUNDED PRECEDING)
)"""

# Number of the quarter hour inside the month; faults are planted by it.
SLOT = "(day(DateTime) * 96 + hour(DateTime) * 4 + minute(DateTime) // 15)"

DIRTY = f"""
dirty AS (
  SELECT symbol, DateTime, open AS "Open",
         CASE WHEN {SLOT} % 11 = 0 THEN low - 5 ELSE high END AS "High", low AS "Low",
         CASE WHEN {SLOT} % 17 = 0 THEN NULL ELSE close END AS "Close",
         CASE WHEN {SLOT} % 13 = 0 THEN -volume ELSE volume END AS "Volume",
         CASE WHEN {SLOT} % 19 = 0 THEN NULL ELSE delta END AS "Delta"
  FROM bars
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"

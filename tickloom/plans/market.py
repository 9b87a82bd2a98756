"""Queries on bars, profiles, lookback and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tickloom.functions.columns import time_text
from tickloom.operators import bars as B
from tickloom.operators import dedup as D
from tickloom.operators import lookback as L
from tickloom.operators import quality as Q
from tickloom.operators import reshape as R
from tickloom.operators.features import delta_by_price
from tickloom.operators.sequence import last_n_per_key
from tickloom.plans import inputs as I
from tickloom.plans.base_sql import BARS, LEVELS, SLOT, STUDIES, TAPE, with_ctes
from tickloom.plans.registry import query, result, rounded
from tickloom.schemas import BAR_KEY, PROFILE, TIME
from tickloom.session import checkpoint_location
from tickloom.sources import files, sinks
from tickloom.sources.tape import table, tape

ON_BARS = with_ctes(TAPE, BARS)
ON_LEVELS = with_ctes(TAPE, LEVELS)
ON_STUDIES = with_ctes(TAPE, BARS, STUDIES)


# -- bars and studies ------------------------------------------------------------------------

@query("bars_ohlcv", ON_BARS + "SELECT symbol, DateTime, open, high, low, close, volume, trades FROM bars")
def bars_ohlcv(spark, sf):
    return result(I.bars(spark, sf), *BAR_KEY, "Open", "High", "Low", "Close", "Volume", "Trades")


@query("vbp_profile", ON_LEVELS + "SELECT * FROM levels")
def vbp_profile(spark, sf):
    return result(I.levels(spark, sf), *BAR_KEY, "Price", "BidVol", "AskVol", "TotalVolume", "NumOfTrades")


@query("vbp_nested", ON_LEVELS + """
SELECT symbol, DateTime, count(*) AS n_levels, min(price) AS min_price, max(price) AS max_price,
       CAST(sum(total_volume) AS BIGINT) AS total_volume
FROM levels GROUP BY 1, 2""")
def vbp_nested(spark, sf):
    volume = F.aggregate(F.col(f"{PROFILE}.TotalVolume"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return I.nested(spark, sf).select(
        *BAR_KEY, F.size(PROFILE).cast("bigint").alias("n_levels"),
        F.array_min(f"{PROFILE}.Price").alias("min_price"), F.array_max(f"{PROFILE}.Price").alias("max_price"),
        volume.alias("total_volume"))


@query("bar_delta", ON_BARS + "SELECT symbol, DateTime, delta FROM bars")
def bar_delta(spark, sf):
    return result(I.bars(spark, sf), *BAR_KEY, "Delta")


@query("cumulative_delta", ON_STUDIES + "SELECT symbol, DateTime, cumulative_delta FROM studies")
def cumulative_delta(spark, sf):
    return result(B.with_cumulative_delta(I.bars(spark, sf)), *BAR_KEY, "CumulativeDelta")


@query("today_levels", ON_STUDIES + "SELECT symbol, DateTime, today_open, today_high, today_low FROM studies")
def today_levels(spark, sf):
    return result(B.with_today_levels(I.bars(spark, sf)), *BAR_KEY, "TodayOpen", "TodayHigh", "TodayLow")


@query("rvol", ON_STUDIES + "SELECT symbol, DateTime, round(rvol, 6) AS rvol FROM studies")
def rvol(spark, sf):
    return rounded(result(B.with_rvol(I.bars(spark, sf)), *BAR_KEY, "RVOL"), 6, "rvol")


@query("large_trades", ON_BARS + "SELECT symbol, DateTime, lt_max_vol, lt_total_vol, large_bid, large_ask FROM bars")
def large_trades(spark, sf):
    return result(I.bars(spark, sf), *BAR_KEY, "LTMaxVol", "LTTotalVol", "LargeBidTrade", "LargeAskTrade")


@query("delta_profile", ON_LEVELS + """
SELECT symbol, price, CAST(sum(ask_vol - bid_vol) AS BIGINT) AS delta FROM levels GROUP BY 1, 2""")
def delta_profile(spark, sf):
    return result(delta_by_price(I.levels(spark, sf)), "symbol", "Price", "Delta")


# -- nested bars to flat rows ----------------------------------------------------------------

@query("flatten_vbp", with_ctes(TAPE, BARS, LEVELS) + f"""
SELECT b.symbol, b.DateTime, b.close, b.volume, l.price, l.bid_vol, l.ask_vol, l.total_volume, l.num_trades
FROM bars b LEFT JOIN levels l
  ON b.symbol = l.symbol AND b.DateTime = l.DateTime AND {SLOT.replace('DateTime', 'b.DateTime')} % 7 <> 0""")
def flatten_vbp(spark, sf):
    bars = I.nested(spark, sf)
    none = F.array().cast(bars.schema[PROFILE].dataType)
    emptied = bars.withColumn(PROFILE, F.when(I.slot() % 7 == 0, none).otherwise(F.col(PROFILE)))
    return result(R.flatten(emptied), *BAR_KEY, "Close", "Volume", "Price", "BidVol", "AskVol", "TotalVolume",
                  "NumOfTrades")


@query("bar_level_outer_join", with_ctes(TAPE, BARS, LEVELS) + f"""
SELECT coalesce(b.symbol, l.symbol) AS symbol, coalesce(b.DateTime, l.DateTime) AS DateTime, b.close, l.price,
       l.total_volume,
       CASE WHEN b.symbol IS NULL THEN 'level' WHEN l.symbol IS NULL THEN 'bar' ELSE 'both' END AS side_flag
FROM (SELECT * REPLACE (CASE WHEN {SLOT} % 5 = 0 THEN symbol || '-bar' ELSE symbol END AS symbol) FROM bars) b
FULL OUTER JOIN (SELECT * REPLACE (CASE WHEN {SLOT} % 7 = 0 THEN symbol || '-level' ELSE symbol END AS symbol) FROM levels) l
  ON b.symbol = l.symbol AND b.DateTime = l.DateTime""")
def bar_level_outer_join(spark, sf):
    """All bars and levels; some of either get a symbol that the other side does not have."""
    def renamed(every, mark):
        return F.when(I.slot() % every == 0, F.concat("symbol", F.lit(mark))).otherwise(F.col("symbol"))

    bars = I.bars(spark, sf).withColumn("symbol", renamed(5, "-bar")).select(*BAR_KEY, "Close")
    levels = I.levels(spark, sf).withColumn("symbol", renamed(7, "-level")).select(*BAR_KEY, "Price", "TotalVolume")
    flag = (F.when(F.col("Close").isNull(), "level").when(F.col("Price").isNull(), "bar").otherwise("both"))
    return result(R.join_levels(bars, levels), *BAR_KEY, "Close", "Price", "TotalVolume", flag.alias("side_flag"))


CLEAN = ["Open", "High", "Low", "Close", "Volume", "RVOL", "TodayOpen", "TodayHigh", "TodayLow", "LTMaxVol",
         "LTTotalVol", "LargeBidTrade", "LargeAskTrade", "Delta", "CumulativeDelta"]


@query("clean_columns", ON_STUDIES + """
SELECT symbol, DateTime, open, high, low, close, volume, round(rvol, 6) AS rvol, today_open, today_high, today_low,
       lt_max_vol, lt_total_vol, large_bid, large_ask, delta, cumulative_delta
FROM studies""")
def clean_columns(spark, sf):
    cleaned = R.clean(B.vendor_bars(tape(spark, sf)))
    # Everything that is left must be a known column: a helper that slipped through would show up.
    kept = [c for c in cleaned.columns if c != PROFILE]
    return rounded(result(cleaned, *BAR_KEY, *[c for c in CLEAN if c in kept],
                          *[c for c in kept if c not in CLEAN and c not in BAR_KEY]), 6, "rvol")


@query("study_columns", ON_STUDIES + """
SELECT symbol, DateTime, round(rvol, 6) AS id6_sg1, today_open AS id4_sg1, today_high AS id4_sg2,
       today_low AS id4_sg3, lt_max_vol AS id9_sg1, lt_total_vol AS id9_sg2, large_bid AS id9_sg3,
       large_ask AS id9_sg4, delta AS id2_sg1, cumulative_delta AS id2_sg10
FROM studies""")
def study_columns(spark, sf):
    chosen = B.study_columns(B.vendor_bars(tape(spark, sf)))
    plain = chosen.toDF(*[c.lower().replace(".", "_") if c.startswith("ID") else c for c in chosen.columns])
    return rounded(plain, 6, "id6_sg1")


@query("vbp_scan", ON_LEVELS + "SELECT symbol, DateTime AS ts, price FROM levels")
def vbp_scan(spark, sf):
    text = I.levels(spark, sf).withColumn(TIME, time_text())
    return result(files.parse_time(text), "symbol", F.col(TIME).alias("ts"), "Price")


@query("csv_history", with_ctes(TAPE, BARS, LEVELS) + f"""
SELECT b.symbol, b.DateTime, b.close, b.volume, l.price, l.bid_vol, l.ask_vol, l.total_volume, l.num_trades
FROM bars b LEFT JOIN levels l
  ON b.symbol = l.symbol AND b.DateTime = l.DateTime AND {SLOT.replace('DateTime', 'b.DateTime')} % 7 <> 0""")
def csv_history(spark, sf):
    """Flat rows written as CSV and read as a history."""
    bars = I.nested(spark, sf)
    none = F.array().cast(bars.schema[PROFILE].dataType)
    emptied = bars.withColumn(PROFILE, F.when(I.slot() % 7 == 0, none).otherwise(F.col(PROFILE)))
    path = sinks.write_csv(R.to_flat(emptied), checkpoint_location(spark))
    return result(files.read_history_csv(spark, path), *BAR_KEY, "Close", "Volume", "Price", "BidVol", "AskVol", "TotalVolume",
                  "NumOfTrades")


@query("csv_mixed_headers", ON_LEVELS + f"""
SELECT symbol, DateTime, price, CASE WHEN {SLOT} % 3 <> 2 THEN total_volume END AS total_volume,
       CASE WHEN {SLOT} % 3 = 1 THEN bid_vol END AS bid_vol FROM levels""")
def csv_mixed_headers(spark, sf):
    """Three exports in one folder, with columns in another order, one more, and one less."""
    root = checkpoint_location(spark)
    layouts = [["DateTime", "symbol", "Price", "TotalVolume"], ["symbol", "TotalVolume", "BidVol", "DateTime", "Price"],
               ["Price", "DateTime", "symbol"]]
    rows = I.levels(spark, sf)
    for k, names in enumerate(layouts):
        sinks.write_csv(rows.filter(I.slot() % 3 == k).select(*names), f"{root}/{k}")
    return result(files.read_history_csv(spark, [f"{root}/{k}" for k in range(3)]), *BAR_KEY, "Price", "TotalVolume", "BidVol")


@query("quarantine_csv", ON_LEVELS + f"""
, faults AS (
  SELECT *, {SLOT} % 11 = 0 AS bad_time, {SLOT} % 7 = 0 AS bad_price, {SLOT} % 5 = 0 AS bad_volume FROM levels)
SELECT symbol, CASE WHEN NOT (bad_time OR bad_price OR bad_volume) THEN DateTime END AS DateTime,
       CASE WHEN NOT (bad_time OR bad_price OR bad_volume) THEN price END AS price,
       CASE WHEN NOT (bad_time OR bad_price OR bad_volume) THEN total_volume END AS total_volume,
       nullif(concat_ws(', ', CASE WHEN bad_time THEN 'DateTime' END, CASE WHEN bad_price THEN 'Price' END,
                        CASE WHEN bad_volume THEN 'TotalVolume' END), '') AS reason
FROM faults""")
def quarantine_csv(spark, sf):
    """A history with bad cells goes through files: good rows to one table, lines that cannot be read to another."""
    rows = I.levels(spark, sf).select(
        "symbol", F.when(I.slot() % 11 == 0, "yesterday").otherwise(time_text()).alias(TIME),
        F.when(I.slot() % 7 == 0, "n/a").otherwise(F.col("Price").cast("string")).alias("Price"),
        F.when(I.slot() % 5 == 0, "1.5e").otherwise(F.col("TotalVolume").cast("string")).alias("TotalVolume"))
    path, target = checkpoint_location(spark), checkpoint_location(spark)
    rows.write.option("header", True).csv(path)
    good, rejects = files.split_history_csv(spark, path, target)
    kept = good.select("symbol", TIME, "Price", "TotalVolume", F.lit(None).cast("string").alias("reason"))
    lost = rejects.select(F.substring_index("line", ",", 1).alias("symbol"), F.lit(None).cast("timestamp_ntz").alias(TIME),
                          F.lit(None).cast("double").alias("Price"), F.lit(None).cast("bigint").alias("TotalVolume"), "reason")
    return result(kept.unionByName(lost), *BAR_KEY, "Price", "TotalVolume", "reason")


@query("export_round_trip", ON_BARS + """
SELECT symbol, DateTime, close, CASE WHEN DateTime >= TIMESTAMP '2024-01-20' THEN volume + 1 ELSE volume END AS volume,
       strftime(DateTime, '%Y-%m-%d') AS trade_date
FROM bars WHERE DateTime < TIMESTAMP '2024-01-20' OR symbol <> 'S0'""")
def export_round_trip(spark, sf):
    """All days are exported, then the last ones again: without a symbol, and with other volumes."""
    bars = I.bars(spark, sf).select(*BAR_KEY, "Close", "Volume")
    path = checkpoint_location(spark)
    sinks.export_days(bars, path)
    again = R.from_date(bars, "2024-01-20").filter("symbol <> 'S0'").withColumn("Volume", F.col("Volume") + 1)
    sinks.export_days(again, path)
    return result(sinks.read_days(spark, path), *BAR_KEY, "Close", "Volume", F.col("trade_date").cast("string").alias("trade_date"))


# -- filters and slices ----------------------------------------------------------------------

@query("bars_last_n", ON_BARS + """
SELECT symbol, DateTime, close, volume FROM bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY DateTime DESC) <= 50""")
def bars_last_n(spark, sf):
    return result(last_n_per_key(I.bars(spark, sf), ["symbol"], TIME, 50), *BAR_KEY, "Close", "Volume")


@query("closed_bars", ON_STUDIES + "SELECT symbol, DateTime, close FROM studies WHERE is_closed")
def closed_bars(spark, sf):
    return result(B.closed_bars(B.with_closed_flag(I.bars(spark, sf))), *BAR_KEY, "Close")


@query("date_cutoff", with_ctes(TAPE) + """
SELECT symbol, ts, trade_id, price, size FROM tape WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'""")
def date_cutoff(spark, sf):
    return R.from_date(tape(spark, sf), "2024-01-15 00:00:00", "ts").select(
        "symbol", "ts", "trade_id", "price", "size")


@query("session_hours", with_ctes(TAPE) + """
SELECT symbol, ts, trade_id, price, size FROM tape
WHERE CAST(ts AS TIME) BETWEEN TIME '08:00:00' AND TIME '15:00:00'""")
def session_hours(spark, sf):
    return R.session_hours(tape(spark, sf), time="ts").select("symbol", "ts", "trade_id", "price", "size")


@query("latest_bar", ON_LEVELS + """
SELECT symbol, DateTime, price, bid_vol, ask_vol, total_volume, num_trades FROM levels
QUALIFY DateTime = max(DateTime) OVER (PARTITION BY symbol)""")
def latest_bar(spark, sf):
    return result(B.latest_bar(I.levels(spark, sf)), *BAR_KEY, "Price", "BidVol", "AskVol", "TotalVolume",
                  "NumOfTrades")


@query("bar_panel", with_ctes(TAPE, BARS, LEVELS, STUDIES) + """
SELECT b.symbol, b.DateTime, any_value(b.open) AS open, any_value(b.high) AS high, any_value(b.low) AS low,
       any_value(b.close) AS close, any_value(b.volume) AS volume, any_value(b.delta) AS delta,
       any_value(b.large_bid) AS large_bid, any_value(b.large_ask) AS large_ask,
       round(coalesce(any_value(b.rvol), 0), 6) AS rvol, any_value(b.cumulative_delta) AS cumulative_delta, count(*) AS n_levels,
       min(l.price) AS min_price, max(l.price) AS max_price, CAST(sum(l.bid_vol) AS BIGINT) AS bid_vol,
       CAST(sum(l.ask_vol) AS BIGINT) AS ask_vol, CAST(sum(l.num_trades) AS BIGINT) AS num_trades
FROM studies b JOIN levels l ON b.symbol = l.symbol AND b.DateTime = l.DateTime GROUP BY 1, 2""")
def bar_panel(spark, sf):
    """Bars as the vendor delivers them, studies included; a missing study shows as 0."""
    panel = R.bar_panel(R.to_flat(B.vendor_bars(tape(spark, sf))))

    def total(name):
        return F.aggregate(F.col(f"Levels.{name}"), F.lit(0).cast("bigint"), lambda a, v: a + v)

    return rounded(result(
        panel, *BAR_KEY, "Open", "High", "Low", "Close", "Volume", "Delta", "LargeBidTrade", "LargeAskTrade", "RVOL",
        "CumulativeDelta", "NumLevels", F.array_min("Levels.Price").alias("min_price"),
        F.array_max("Levels.Price").alias("max_price"), total("BidVol").alias("bid_vol"),
        total("AskVol").alias("ask_vol"), total("NumOfTrades").alias("num_trades")), 6, "rvol")


@query("slices", ON_LEVELS + """
, placed AS (
  SELECT symbol, DateTime, price, row_number() OVER (ORDER BY DateTime, price, symbol) - 1 AS place,
         count(*) OVER () AS n FROM levels)
SELECT s.slice, symbol, DateTime, price
FROM placed, (VALUES ('head'), ('tail'), ('middle')) s(slice)
WHERE (slice = 'head' AND place < 10) OR (slice = 'tail' AND place >= n - 5)
   OR (slice = 'middle' AND place >= n // 2 AND place < n // 2 + 5)""")
def slices(spark, sf):
    levels = I.levels(spark, sf).select(*BAR_KEY, "Price")
    parts = {"head": R.head(levels, 10), "tail": R.tail(levels, 5), "middle": R.middle(levels, 5)}
    named = [result(df, F.lit(name).alias("slice"), *BAR_KEY, "Price") for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


@query("sample_n", ON_LEVELS + """
SELECT symbol, DateTime, price, total_volume FROM levels
ORDER BY md5('7|' || symbol || '|' || CAST(DateTime AS VARCHAR) || '|' || CAST(price AS VARCHAR)) LIMIT 1000""")
def sample_n(spark, sf):
    return result(R.sample_n(I.levels(spark, sf), 1000, [*BAR_KEY, "Price"], seed=7), *BAR_KEY, "Price",
                  "TotalVolume")


@query("run_summary", ON_LEVELS + """
SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns, min(DateTime) AS min_ts, max(DateTime) AS max_ts FROM levels""")
def run_summary(spark, sf):
    return sinks.run_summary(I.levels(spark, sf))


# -- lookback --------------------------------------------------------------------------------

LOOKBACK_SQL = with_ctes(TAPE, BARS, LEVELS, """
heads AS (
  SELECT b.*, l.price AS head_price, dense_rank() OVER (PARTITION BY b.symbol ORDER BY b.DateTime) - 1 AS bar_index
  FROM bars b JOIN levels l ON b.symbol = l.symbol AND b.DateTime = l.DateTime
  QUALIFY row_number() OVER (PARTITION BY b.symbol, b.DateTime ORDER BY l.price) = 1
)""")


@query("bar_index", ON_STUDIES + "SELECT symbol, DateTime, bar_index FROM studies")
def bar_index(spark, sf):
    return L.bar_index(I.bars(spark, sf)).select(*BAR_KEY, F.col("index").alias("bar_index"))


@query("lookback_current", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, h.close, h.volume, l.DateTime AS "timestamp", h.bar_index AS "index"
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime""")
def lookback_current(spark, sf):
    records = L.market_records(L.level_lookback(I.nested(spark, sf), columns=["Close"]))
    return result(L.current_only(records), *BAR_KEY, "Price", "Close", "Volume", "timestamp", "index")


@query("lookback_t1", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, h.close, p.DateTime AS t1_ts, p.head_price AS t1_price,
       p.close AS t1_close, p.volume AS t1_volume
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime
LEFT JOIN heads p ON p.symbol = h.symbol AND p.bar_index = h.bar_index - 1""")
def lookback_t1(spark, sf):
    rows = L.level_lookback(I.nested(spark, sf), 1, ["Price", "Close", "Volume"])
    t1 = F.get("lookback", F.lit(0))
    return result(rows, *BAR_KEY, "Price", "Close", t1["timestamp"].alias("t1_ts"), t1["Price"].alias("t1_price"),
                  t1["Close"].alias("t1_close"), t1["Volume"].alias("t1_volume"))


@query("lookback_n", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, h.bar_index - p.bar_index AS i, p.DateTime AS t_ts, p.head_price AS t_price,
       p.close AS t_close
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime
JOIN heads p ON p.symbol = h.symbol AND p.bar_index BETWEEN h.bar_index - 10 AND h.bar_index - 1""")
def lookback_n(spark, sf):
    rows = L.level_lookback(I.nested(spark, sf), 10, ["Price", "Close"])
    long = rows.select(*BAR_KEY, "Price", F.posexplode("lookback").alias("at", "t"))
    return result(long, *BAR_KEY, "Price", (F.col("at") + 1).cast("bigint").alias("i"),
                  F.col("t.timestamp").alias("t_ts"), F.col("t.Price").alias("t_price"),
                  F.col("t.Close").alias("t_close"))


@query("lookback_flat", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, p.DateTime AS t3_ts, p.head_price AS t3_price, p.close AS t3_close
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime
LEFT JOIN heads p ON p.symbol = h.symbol AND p.bar_index = h.bar_index - 3""")
def lookback_flat(spark, sf):
    flat = R.flatten(I.nested(spark, sf))
    rows = L.flat_lookback(flat, 3, ["Price", "Close"])
    t3 = F.get("lookback", F.lit(2))
    return result(rows, *BAR_KEY, "Price", t3["timestamp"].alias("t3_ts"), t3["Price"].alias("t3_price"),
                  t3["Close"].alias("t3_close"))


@query("feature_subset", ON_BARS + """
SELECT symbol, DateTime, open, high, low, close, volume, delta, lag(close, 1) OVER w AS t1_close,
       lag(volume, 1) OVER w AS t1_volume, lag(delta, 1) OVER w AS t1_delta, lag(close, 3) OVER w AS t3_close,
       lag(delta, 3) OVER w AS t3_delta
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY DateTime)""")
def feature_subset(spark, sf):
    made = L.feature_table(I.bars(spark, sf), ["OHLCV", "Delta"], 3)
    past = [F.col(c).alias(c.lower()) for c in ("t1_Close", "t1_Volume", "t1_Delta", "t3_Close", "t3_Delta")]
    return result(made, *BAR_KEY, "Open", "High", "Low", "Close", "Volume", "Delta", *past)


@query("close_change", ON_BARS + """
SELECT symbol, DateTime, close - lag(close) OVER (PARTITION BY symbol ORDER BY DateTime) AS close_change FROM bars""")
def close_change(spark, sf):
    return result(L.close_change(I.bars(spark, sf)), *BAR_KEY, "CloseChange")


@query("avg_volume_5", ON_BARS + """
SELECT symbol, DateTime, CASE WHEN count(volume) OVER w = 5 THEN round(avg(volume) OVER w, 6) END AS avg_volume
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY DateTime ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def avg_volume_5(spark, sf):
    return L.mean_volume(I.bars(spark, sf), 5).select(*BAR_KEY, F.round("AvgVolume5", 6).alias("avg_volume"))


@query("rvol_alert", ON_STUDIES + """
, changed AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY DateTime) AS close_change FROM studies)
SELECT symbol, DateTime, round(rvol, 6) AS rvol, close_change FROM changed WHERE rvol > 2""")
def rvol_alert(spark, sf):
    return rounded(result(L.rvol_alerts(I.bars(spark, sf)), *BAR_KEY, "RVOL", "CloseChange"), 6, "rvol")


@query("quarantine", ON_LEVELS + f"""
SELECT CASE WHEN {SLOT} % 23 = 0 THEN 'bad_time' WHEN {SLOT} % 29 = 0 THEN 'bad_price'
            WHEN {SLOT} % 37 = 0 THEN 'bad_volume' ELSE 'ok' END AS reason, count(*) AS n
FROM levels GROUP BY 1""")
def quarantine(spark, sf):
    s = I.slot()
    text = I.levels(spark, sf).select(
        "symbol",
        F.when(s % 23 == 0, "not a time").otherwise(F.col(TIME).cast("string")).alias(TIME),
        F.when(s % 29 == 0, "n/a").otherwise(F.col("Price").cast("string")).alias("Price"),
        F.when(s % 37 == 0, "-1").otherwise(F.col("TotalVolume").cast("string")).alias("TotalVolume"))
    return Q.quarantine(text).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# -- duplicates ------------------------------------------------------------------------------

VALUES = ["symbol", "event_type", "value"]


def _value_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"), "event_type", "value", "ts")


VALUE_ROWS_SQL = with_ctes("""
rows AS (SELECT 'S' || (user_id % 4) AS symbol, event_type, value, ts FROM events)""")


@query("dedup_values", VALUE_ROWS_SQL + """
SELECT symbol, event_type, value, ts AS first_ts FROM rows
QUALIFY row_number() OVER (PARTITION BY symbol, event_type, value ORDER BY ts) = 1""")
def dedup_values(spark, sf):
    first = D.first_occurrences(_value_rows(spark, sf), VALUES, "ts", include_time=False)
    return first.withColumnRenamed("ts", "first_ts")


@query("union_dedup", VALUE_ROWS_SQL + """
, both_parts AS (
  SELECT * FROM rows WHERE ts < TIMESTAMP '2024-01-20' UNION ALL SELECT * FROM rows WHERE ts >= TIMESTAMP '2024-01-10')
SELECT symbol, event_type, value, min(ts) AS first_ts FROM both_parts GROUP BY 1, 2, 3""")
def union_dedup(spark, sf):
    rows = _value_rows(spark, sf)
    history = rows.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    update = R.from_date(rows, "2024-01-10", "ts")
    first = D.first_occurrences(R.append_rows(history, update), VALUES, "ts", include_time=False)
    return first.withColumnRenamed("ts", "first_ts")


@query("dedup_anti", VALUE_ROWS_SQL + """
SELECT symbol, event_type, value, min(ts) AS first_ts FROM rows n
WHERE ts >= TIMESTAMP '2024-01-20' AND NOT EXISTS (
  SELECT 1 FROM rows s WHERE s.ts < TIMESTAMP '2024-01-20' AND s.symbol IS NOT DISTINCT FROM n.symbol
    AND s.event_type IS NOT DISTINCT FROM n.event_type AND s.value IS NOT DISTINCT FROM n.value)
GROUP BY 1, 2, 3""")
def dedup_anti(spark, sf):
    rows = _value_rows(spark, sf)
    seen = rows.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    fresh = D.unseen(R.from_date(rows, "2024-01-20", "ts"), seen, VALUES, "ts", include_time=False)
    return fresh.withColumnRenamed("ts", "first_ts")


# -- other time frames -----------------------------------------------------------------------

@query("resample_hourly", ON_BARS + """
SELECT symbol, time_bucket(INTERVAL '1 hour', DateTime) AS period, round(avg(close), 6) AS mean_close
FROM bars GROUP BY 1, 2""")
def resample_hourly(spark, sf):
    return rounded(B.resample_mean(I.bars(spark, sf)), 6, "mean_close")


@query("resample_daily", ON_BARS + """
SELECT symbol, time_bucket(INTERVAL '1 day', DateTime) AS period, arg_max(close, DateTime) AS last_close
FROM bars GROUP BY 1, 2""")
def resample_daily(spark, sf):
    return B.resample_last(I.bars(spark, sf))


@query("seasonality", ON_BARS + """
SELECT hour(DateTime) AS hour, dayofweek(DateTime) + 1 AS dow, round(avg(volume), 6) AS mean_volume, count(*) AS n
FROM bars GROUP BY 1, 2""")
def seasonality(spark, sf):
    seasons = R.seasonality(I.bars(spark, sf))
    return rounded(seasons.withColumns({c: F.col(c).cast("bigint") for c in ("hour", "dow")}), 6, "mean_volume")


@query("train_test_split", ON_BARS + """
, times AS (SELECT DateTime, percent_rank() OVER (ORDER BY DateTime) AS pr FROM (SELECT DISTINCT DateTime FROM bars))
SELECT CASE WHEN DateTime <= (SELECT max(DateTime) FROM times WHERE pr <= 0.8) THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, min(DateTime) AS min_ts, max(DateTime) AS max_ts
FROM bars GROUP BY 1""")
def train_test_split(spark, sf):
    return R.train_test_split(I.bars(spark, sf), 0.2).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(TIME).alias("min_ts"), F.max(TIME).alias("max_ts"))

"""Time bars, volume-by-price profiles and study columns from a trade tape."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import bar_start, day, quoted, side_volume
from tickloom.operators.sequence import asof_join, framed, latest_per_key, running
from tickloom.schemas import (
    BAR_KEY, HELPER_COLUMNS, PROFILE, STUDIES, SYMBOL, TIME, VENDOR_NAMES,
)
from tickloom.sources.tape import TAPE_ORDER

DEFAULT_WIDTH = "15 minutes"
LARGE_TRADE = 90
RVOL_BARS = 20


def in_bars(tape: DataFrame, width: str = DEFAULT_WIDTH) -> DataFrame:
    """Trades with the start of their bar in DateTime."""
    return tape.withColumn(TIME, bar_start("ts", width))


def _trade_key(tape: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value per trade.

    A struct would do, but aggregates over structs sort their input. A time and a whole number,
    the usual order, fit one decimal, and decimals aggregate by hash: microseconds take the upper
    18 digits, the number, shifted to be positive, the lower 20.
    """
    kinds = [tape.schema[c].dataType for c in order]
    if len(order) == 1:
        return F.col(order[0])
    # Zone-free times have exact microseconds only where the session adds no zone of its own.
    exact = isinstance(kinds[0], T.TimestampType) or (
        isinstance(kinds[0], T.TimestampNTZType)
        and tape.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"))
    if len(order) == 2 and exact and isinstance(kinds[1], T.IntegralType):
        micros = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(18,0)")
        number = F.col(order[1]).cast("decimal(20,0)") + F.lit(Decimal(2 ** 63)).cast("decimal(20,0)")
        return micros * F.lit(Decimal(10 ** 20)).cast("decimal(21,0)") + number
    return F.struct(*order)


def _large(value: Column, threshold: int) -> Column:
    return F.when(F.col("size") >= threshold, value)


def ohlcv(tape: DataFrame, width: str = DEFAULT_WIDTH, order: Sequence[str] = TAPE_ORDER,
          large: int = LARGE_TRADE) -> DataFrame:
    """One row per symbol and bar, with delta and large-trade volumes.

    Every aggregate combines map-side, so a busy bar ships one row per input partition.
    """
    key = _trade_key(tape, order)
    is_large_bid = (F.col("side") == "bid") & (F.col("size") >= large)
    is_large_ask = (F.col("side") == "ask") & (F.col("size") >= large)
    none = F.lit(0)
    aggregates = [
        F.min_by("price", key).alias("Open"),
        F.max("price").alias("High"),
        F.min("price").alias("Low"),
        F.max_by("price", key).alias("Close"),
        F.sum("size").alias("Volume"),
        F.count(F.lit(1)).alias("Trades"),
        (side_volume("ask") - side_volume("bid")).alias("Delta"),
        F.coalesce(F.max(_large(F.col("size"), large)), none).alias("LTMaxVol"),
        F.coalesce(F.sum(_large(F.col("size"), large)), none).alias("LTTotalVol"),
        F.coalesce(F.sum(F.when(is_large_bid, F.col("size"))), none).alias("LargeBidTrade"),
        F.coalesce(F.sum(F.when(is_large_ask, F.col("size"))), none).alias("LargeAskTrade"),
    ]
    if not tape.isStreaming:
        return in_bars(tape, width).groupBy(*BAR_KEY).agg(*aggregates)
    # Only a group on the window itself lets the watermark close bars.
    made = tape.groupBy(SYMBOL, F.window("ts", width).alias("bar")).agg(*aggregates)
    return made.select(SYMBOL, F.col("bar.start").alias(TIME), *made.columns[2:])


def _level_totals(binned: DataFrame, *extra: Column) -> DataFrame:
    return binned.groupBy(*BAR_KEY, F.col("price").alias("Price")).agg(
        side_volume("bid").alias("BidVol"),
        side_volume("ask").alias("AskVol"),
        F.sum("size").alias("TotalVolume"),
        F.count(F.lit(1)).alias("NumOfTrades"),
        *extra,
    )


def profile(tape: DataFrame, width: str = DEFAULT_WIDTH) -> DataFrame:
    """One row per symbol, bar and price level."""
    return _level_totals(in_bars(tape, width))


def nested_bars(tape: DataFrame, width: str = DEFAULT_WIDTH, order: Sequence[str] = TAPE_ORDER,
                large: int = LARGE_TRADE) -> DataFrame:
    """Bars with their profile as an array, in one pass over the tape.

    Trades collapse to price levels first; bars are then built from levels, which are far
    fewer. A profile holds one entry per distinct tick price of its bar.
    """
    key = _trade_key(tape, order)
    size = F.col("size")
    big = size >= large
    levels = _level_totals(
        in_bars(tape, width),
        F.min(key).alias("first"), F.max(key).alias("last"),
        F.max(F.when(big, size)).alias("big_max"), F.sum(F.when(big, size)).alias("big_sum"),
        F.sum(F.when(big & (F.col("side") == "bid"), size)).alias("big_bid"),
        F.sum(F.when(big & (F.col("side") == "ask"), size)).alias("big_ask"),
    )
    level = F.struct("Price", "BidVol", "AskVol", "TotalVolume", "NumOfTrades")
    none = F.lit(0)
    return levels.groupBy(*BAR_KEY).agg(
        F.min_by("Price", "first").alias("Open"),
        F.max("Price").alias("High"),
        F.min("Price").alias("Low"),
        F.max_by("Price", "last").alias("Close"),
        F.sum("TotalVolume").alias("Volume"),
        F.sum("NumOfTrades").alias("Trades"),
        (F.sum("AskVol") - F.sum("BidVol")).alias("Delta"),
        F.coalesce(F.max("big_max"), none).alias("LTMaxVol"),
        F.coalesce(F.sum("big_sum"), none).alias("LTTotalVol"),
        F.coalesce(F.sum("big_bid"), none).alias("LargeBidTrade"),
        F.coalesce(F.sum("big_ask"), none).alias("LargeAskTrade"),
        F.sort_array(F.collect_list(level)).alias(PROFILE),
    )


def with_cumulative_delta(bars: DataFrame) -> DataFrame:
    """Running delta over all bars of a symbol, never reset; adds position and closed flag too.

    All come from one prefix sum: `index` is the bar's 0-based position, which operators behind
    this one can be given as `position` while no bar is filtered out in between, and IsBarClosed is false on the latest bar.
    """
    placed = running(bars, [SYMBOL], TIME, {"index": F.lit(1), "CumulativeDelta": F.col("Delta")},
                     totals={"__bars": "index"})
    return (placed.withColumn("index", (F.col("index") - 1).cast("bigint"))
            .withColumn(HELPER_COLUMNS[0], F.col("index") < F.col("__bars") - 1).drop("__bars"))


def with_session_delta(bars: DataFrame) -> DataFrame:
    """Running delta that starts again every day."""
    so_far = (Window.partitionBy(SYMBOL, day()).orderBy(TIME)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bars.withColumn("SessionDelta", F.sum("Delta").over(so_far))


def with_today_levels(bars: DataFrame) -> DataFrame:
    """The day's first price and its high and low so far. A day bounds each window."""
    so_far = (Window.partitionBy(SYMBOL, day()).orderBy(TIME)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return bars.select(
        "*",
        F.first("Open").over(so_far).alias("TodayOpen"),
        F.max("High").over(so_far).alias("TodayHigh"),
        F.min("Low").over(so_far).alias("TodayLow"),
    )


def _rvol(window, n: int) -> Column:
    return F.col("Volume") / F.avg("Volume").over(window.rowsBetween(-n, -1))


def with_rvol(bars: DataFrame, n: int = RVOL_BARS, position: str | None = None) -> DataFrame:
    """Volume over the mean volume of up to n earlier bars; NULL on a symbol's first bar."""
    return framed(bars, [SYMBOL], TIME, n, lambda w: {"RVOL": _rvol(w, n)}, position)


def with_studies(bars: DataFrame, rvol_bars: int = RVOL_BARS) -> DataFrame:
    """All study columns on bars that carry delta and large-trade volumes, and the closed flag.

    Position, cumulative delta and flag share one prefix sum, so `bars` is evaluated once for the
    rows and once, narrow, for the daily totals.
    """
    return with_today_levels(with_rvol(with_cumulative_delta(bars), rvol_bars, "index"))


def with_closed_flag(bars: DataFrame) -> DataFrame:
    """IsBarClosed is false on each symbol's latest bar."""
    last = bars.groupBy(SYMBOL).agg(F.max(TIME).alias("__last"))
    return (bars.join(last, SYMBOL)
            .withColumn(HELPER_COLUMNS[0], F.col(TIME) < F.col("__last")).drop("__last"))


def closed_bars(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col(HELPER_COLUMNS[0]))


def vendor_bars(tape: DataFrame, width: str = DEFAULT_WIDTH, order: Sequence[str] = TAPE_ORDER) -> DataFrame:
    """Bars under the vendor's column names, profile included."""
    named = with_studies(nested_bars(tape, width, order))
    return named.withColumnsRenamed({ours: theirs for theirs, ours in VENDOR_NAMES.items()}).drop(
        "Trades", "index")


def study_columns(bars: DataFrame, studies: dict[int, list[int]] | None = None) -> DataFrame:
    """Key plus the chosen ID{study}.SG{subgraph} columns."""
    wanted = studies or STUDIES
    return bars.select(*BAR_KEY, *[f"`ID{i}.SG{j}`" for i, subgraphs in wanted.items() for j in subgraphs])


def latest_bar(df: DataFrame) -> DataFrame:
    return latest_per_key(df, [SYMBOL], TIME)


def resample_mean(bars: DataFrame, width: str = "1 hour", column: str = "Close") -> DataFrame:
    return (bars.withColumn("period", bar_start(TIME, width)).groupBy(SYMBOL, "period")
            .agg(F.avg(column).alias(f"mean_{column.lower()}")))


def resample_last(bars: DataFrame, width: str = "1 day", column: str = "Close") -> DataFrame:
    return (bars.withColumn("period", bar_start(TIME, width)).groupBy(SYMBOL, "period")
            .agg(F.max_by(column, TIME).alias(f"last_{column.lower()}")))


# Names of the coarser bars' columns start with these.
TIMEFRAMES = {"Hour": "1 hour", "Day": "1 day"}


def coarser(bars: DataFrame, width: str) -> DataFrame:
    """Bars put together to wider ones, with the time they end."""
    made = bars.withColumn("__start", bar_start(TIME, width)).groupBy(SYMBOL, "__start").agg(
        F.min_by("Open", TIME).alias("Open"), F.max("High").alias("High"), F.min("Low").alias("Low"),
        F.max_by("Close", TIME).alias("Close"), F.sum("Volume").alias("Volume"), F.sum("Delta").alias("Delta"))
    return made.withColumn("__end", F.col("__start") + F.expr(f"INTERVAL {width}")).withColumnRenamed("__start", "Start")


def multi_timeframe(bars: DataFrame, frames: dict[str, str] | None = None) -> DataFrame:
    """Each bar with the last wider bars that were closed when it began: HourStart, HourOpen, ... DayDelta.

    A wider bar is closed once its time is over, so nothing a bar carries was unknown at its start. Holes in the
    history stretch the distance; before the first closed one the columns are NULL.
    """
    chosen = frames or TIMEFRAMES
    rights = {name: (coarser(bars, width), "__end") for name, width in chosen.items()}
    joined = asof_join(bars, rights, [SYMBOL], TIME)
    parts = ["Start", "Open", "High", "Low", "Close", "Volume", "Delta"]
    return joined.select(*[quoted(c) for c in bars.columns], *[
        F.col(f"{name}.{c}").alias(name + c) for name in chosen for c in parts])

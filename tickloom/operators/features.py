"""Order-flow and profile features on bars and levels.

Thresholds the sources leave open are parameters. Per-bar groups are bounded by the price grid,
history frames by their length; ranks over a symbol's whole history go through counts per value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import day
from tickloom.operators.sequence import carried, framed, islands, join_alike, lagged, running, with_position
from tickloom.schemas import (
    ACCUMULATION, BAR_KEY, BUYING_EXHAUSTED, DISTRIBUTION, IMBALANCE, NO_SIGNAL, REVERSAL_DOWN, REVERSAL_UP, SELLING_EXHAUSTED,
    SMART_BUYING, SMART_SELLING, STRONG_BREAKOUT, SYMBOL, TIME, VALUE_AREA,
)


# -- profile of a bar ------------------------------------------------------------------------

def point_of_control(levels: DataFrame) -> DataFrame:
    """Price with the largest volume per bar, the lowest one on a tie."""
    by_size = _bar_window().orderBy(F.col("TotalVolume").desc(), F.col("Price").asc_nulls_last())
    return (levels.withColumn("__rn", F.row_number().over(by_size)).filter(F.col("__rn") == 1)
            .select(*BAR_KEY, F.col("Price").alias("PocPrice")))


def _bar_window():
    return Window.partitionBy(*BAR_KEY)


def volume_share(levels: DataFrame) -> DataFrame:
    return levels.select(*BAR_KEY, "Price",
                         (F.col("TotalVolume") / F.sum("TotalVolume").over(_bar_window())).alias("Share"))


def value_area(levels: DataFrame, share: float = VALUE_AREA) -> DataFrame:
    """Price range of the largest levels that together hold `share` of a bar's volume."""
    by_size = _bar_window().orderBy(F.col("TotalVolume").desc(), "Price")
    before = F.sum("TotalVolume").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    ranked = levels.select(*BAR_KEY, "Price", "TotalVolume",
                           F.coalesce(before, F.lit(0)).alias("before"),
                           F.sum("TotalVolume").over(_bar_window()).alias("total"))
    return ranked.filter(F.col("before") < F.col("total") * share).groupBy(*BAR_KEY).agg(
        F.min("Price").alias("VaLow"), F.max("Price").alias("VaHigh"), F.sum("TotalVolume").alias("VaVolume"))


def delta_by_price(levels: DataFrame) -> DataFrame:
    return levels.groupBy(SYMBOL, "Price").agg(F.sum(F.col("AskVol") - F.col("BidVol")).alias("Delta"))


def developing_poc(levels: DataFrame) -> DataFrame:
    """At every bar, the price with the largest volume of the day so far, the lowest one on a tie.

    Volumes only grow, so the leader is the largest (volume so far, price) that any bar up to now has set: prefix
    sums per price, the best of each bar, and a running maximum. Every window is one day of a symbol or less.
    """
    so_far = Window.partitionBy(SYMBOL, day(), "Price").orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = levels.filter(F.col("Price").isNotNull()).select(*BAR_KEY, "Price", F.sum("TotalVolume").over(so_far).alias("__volume"))
    best = grown.groupBy(*BAR_KEY).agg(F.max(F.struct("__volume", (-F.col("Price")).alias("__price"))).alias("__best"))
    session = Window.partitionBy(SYMBOL, day()).orderBy(TIME).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    led = best.select(*BAR_KEY, F.max("__best").over(session).alias("__lead"))
    return led.select(*BAR_KEY, (-F.col("__lead.__price")).alias("PocPrice"), F.col("__lead.__volume").alias("PocVolume"))


# -- signals ---------------------------------------------------------------------------------

def delta_divergence(bars: DataFrame, position: str | None = None) -> DataFrame:
    """Higher high on a lower cumulative delta, or lower low on a higher one."""
    past = lagged(bars, [SYMBOL], TIME, {"__h": "High", "__l": "Low", "__c": "CumulativeDelta"}, position=position)
    bearish = (F.col("High") > F.col("__h")) & (F.col("CumulativeDelta") < F.col("__c"))
    bullish = (F.col("Low") < F.col("__l")) & (F.col("CumulativeDelta") > F.col("__c"))
    return past.select(*BAR_KEY, F.when(bearish, REVERSAL_DOWN)
                       .when(bullish, REVERSAL_UP).otherwise(NO_SIGNAL).alias("signal"))


def institutional_flow(bars: DataFrame, ratio: float = IMBALANCE) -> DataFrame:
    bid, ask = F.col("LargeBidTrade"), F.col("LargeAskTrade")
    return bars.select(*BAR_KEY, F.when((ask > bid * ratio) & (F.col("Delta") > 0), SMART_BUYING)
                       .when((bid > ask * ratio) & (F.col("Delta") < 0), SMART_SELLING)
                       .otherwise(NO_SIGNAL).alias("signal"))


def accumulation(bars: DataFrame, max_range: float, min_delta: float) -> DataFrame:
    """Strong buying inside a narrow price range."""
    quiet = F.col("High") - F.col("Low") < max_range
    return bars.select(*BAR_KEY, F.when(quiet & (F.col("Delta") > min_delta), ACCUMULATION)
                       .otherwise(NO_SIGNAL).alias("signal"))


def breakout(bars: DataFrame, n: int = 20, min_delta: float = 0, position: str | None = None) -> DataFrame:
    """Close above the high of the n bars before, with delta and cumulative delta behind it."""
    def columns(window):
        return {"__top": F.max("High").over(window.rowsBetween(-n, -1)),
                "__cum": F.lag("CumulativeDelta").over(window)}

    seen = framed(bars, [SYMBOL], TIME, n, columns, position)
    strong = ((F.col("Close") > F.col("__top")) & (F.col("CumulativeDelta") > F.col("__cum"))
              & (F.col("Delta") > min_delta))
    return seen.select(*BAR_KEY, F.when(strong, STRONG_BREAKOUT).otherwise(NO_SIGNAL).alias("signal"))


def delta_alert(bars: DataFrame, n: int = 20, factor: float = 2.0) -> DataFrame:
    """Bars with |Delta| > factor * RVOL * mean volume of the n bars before."""
    def columns(window):
        return {"__mean": F.avg("Volume").over(window.rowsBetween(-n, -1))}

    seen = framed(bars, [SYMBOL], TIME, n, columns)
    limit = factor * (F.col("Volume") / F.col("__mean")) * F.col("__mean")
    return seen.filter(F.abs("Delta") > limit).select(*BAR_KEY, "Delta", "Volume")


def delta_trend_reversal(bars: DataFrame, min_bars: int = 3) -> DataFrame:
    """Bars where cumulative delta turns after moving one way for `min_bars` bars or more.

    A bar without a move, or with a NULL delta, goes on with the move before it. Gives the new direction, and the length and
    total move of the run that ended.
    """
    runs = islands(bars, [SYMBOL], TIME, F.when(F.col("Delta") > 0, 1).when(F.col("Delta") < 0, -1))
    per_run = runs.filter(F.col("run").isNotNull()).groupBy(SYMBOL, "run", "state").agg(
        F.min(TIME).alias(TIME), F.count(F.lit(1)).alias("bars"), F.sum("Delta").alias("move"))
    ended = per_run.select(SYMBOL, (F.col("run") + 1).alias("run"), "bars", "move")
    turned = join_alike(per_run.select(SYMBOL, TIME, "run", "state"), ended, [SYMBOL, "run"])
    return turned.filter(F.col("bars") >= min_bars).select(
        *BAR_KEY, F.when(F.col("state") > 0, "up").otherwise("down").alias("direction"), "bars", "move")


def large_trade_alert(bars: DataFrame, ratio: float = IMBALANCE, min_bars: int = 3) -> DataFrame:
    """The bar at which large trades have been on one side for `min_bars` bars in a row.

    A bar leans to a side whose large volume is more than `ratio` times the other's. One without large trades goes on with
    the lean before it; one with both sides alike ends it.
    """
    bid, ask = F.col("LargeBidTrade"), F.col("LargeAskTrade")
    lean = F.when((bid == 0) & (ask == 0), None).when(ask > bid * ratio, 1).when(bid > ask * ratio, -1).otherwise(0)
    runs = islands(bars, [SYMBOL], TIME, lean)
    return runs.filter((F.col("place") == min_bars - 1) & (F.col("state") != 0)).select(
        *BAR_KEY, F.when(F.col("state") > 0, ACCUMULATION).otherwise(DISTRIBUTION).alias("signal"))


# -- delta transforms ------------------------------------------------------------------------

def delta_ratio(bars: DataFrame) -> DataFrame:
    return bars.select(*BAR_KEY, (F.col("Delta") / F.nullif(F.col("Volume"), F.lit(0))).alias("value"))


def delta_slope(bars: DataFrame, n: int = 5, position: str | None = None) -> DataFrame:
    """Least-squares slope of cumulative delta per bar over the last n bars (NULL until n exist).

    Positions are whole numbers, so their moments are known and two sums give the slope.
    """
    def columns(window):
        recent = window.rowsBetween(-(n - 1), 0)
        return {"__ys": F.collect_list("CumulativeDelta").over(recent)}

    seen = framed(bars, [SYMBOL], TIME, n - 1, columns, position)
    middle = (n - 1) / 2
    spread = sum((i - middle) ** 2 for i in range(n))
    weighted = F.lit(0.0)
    for i in range(n):
        weighted = weighted + F.get("__ys", F.lit(i)) * F.lit(i - middle)
    return seen.select(*BAR_KEY, F.when(F.size("__ys") == n, weighted / spread).alias("value"))


def delta_ema(bars: DataFrame, span: int = 10) -> DataFrame:
    """Exponential mean of delta over all bars so far, weights normalised over the bars that have a delta.

    A bar's weight falls with every bar that follows it, with or without a delta; a bar without one shows the mean
    before it. The recurrence s = delta + decay * s is solved in blocks: inside a block by a running sum of deltas scaled up
    with their place, and from the block before by its end value. A block is so long that what came before its predecessor is 2^-500 of that
    or less, which whole numbers cannot make up for.
    """
    if span <= 1:  # only the newest delta weighs anything
        deltas = bars.select(*BAR_KEY, F.col("Delta").cast("double").alias("__delta"))
        return carried(deltas, [SYMBOL], [TIME], {"value": "__delta"}).select(*BAR_KEY, "value")
    decay = 1 - 2.0 / (span + 1)
    size = int(500 * math.log(2) / -math.log(decay))
    placed = with_position(bars.select(*BAR_KEY, "Delta"), [SYMBOL], TIME, out="__at")
    offset = F.col("__at") % size
    given = F.col("Delta").isNotNull()
    blocked = placed.withColumn("__block", F.floor(F.col("__at") / size))
    base = F.lit(decay)
    scaled = {"n": F.when(given, F.col("Delta") * F.pow(base, -offset)), "d": F.when(given, F.pow(base, -offset))}
    ends = blocked.groupBy(SYMBOL, "__block").agg(*[
        (F.sum(v) * F.pow(base, F.lit(size - 1))).alias(f"__e{n}") for n, v in scaled.items()])
    earlier = Window.partitionBy(SYMBOL).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__t_end", F.when(F.col("__ed").isNotNull(), F.struct("__block", "__en", "__ed")))
    ends = ends.select(SYMBOL, "__block", F.last("__t_end", ignorenulls=True).over(earlier).alias("__end"))
    inside = Window.partitionBy(SYMBOL, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.select("*", offset.alias("__off"), *[F.sum(v).over(inside).alias(f"__i{n}") for n, v in scaled.items()])
    joined = join_alike(local, ends, [SYMBOL, "__block"])
    # Steps from the end of the block that is carried to this bar
    age = F.col("__off") + 1 + size * (F.col("__block") - F.col("__end.__block") - 1)
    past = F.coalesce(F.pow(base, age), F.lit(0.0))
    value = [F.col(f"__i{n}") * F.pow(base, F.col("__off")) + past * F.coalesce(F.col(f"__end.__e{n}"), F.lit(0.0)) for n in scaled]
    return joined.select(*BAR_KEY, F.when(F.col("__id").isNull(), F.col("__end.__en") / F.col("__end.__ed"))
                         .otherwise(value[0] / value[1]).alias("value"))


def delta_change(bars: DataFrame, n: int = 1) -> DataFrame:
    past = lagged(bars, [SYMBOL], TIME, {"__d": "Delta"}, n)
    return past.select(*BAR_KEY, (F.col("Delta") - F.col("__d")).alias("value"))


def percent_rank(bars: DataFrame, column: str, keys: Sequence[str] = (SYMBOL,), pieces: int = 4096) -> DataFrame:
    """Share of the symbol's other bars with a smaller value: (rank - 1) / (rows - 1).

    Values are counted first and ranked by a prefix sum over `pieces` ranges between the column's smallest and largest value,
    so no task sorts a symbol's history, whatever the column's scale. Every row stays; one without a value or a symbol has a
    NULL rank.
    """
    keys = list(keys)
    ends = bars.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, width = ends[0] or 0.0, ((ends[1] or 0.0) - (ends[0] or 0.0)) / pieces or 1.0
    counts = bars.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, keys, column, {"__upto": F.col("__n")}, F.floor((F.col(column).cast("double") - F.lit(low)) / F.lit(width)),
                     {"__all": "__upto"})
    share = (F.col("__upto") - F.col("__n")) / F.nullif(F.col("__all") - 1, F.lit(0))
    values = ranked.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(column).alias("__value"),
                           F.coalesce(share, F.lit(0.0)).alias("PercentRank"))
    same = F.col(column) == F.col("__value")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__k_{k}"))
    return bars.join(values, same, "left").drop("__value", *[f"__k_{k}" for k in keys])


def delta_percentile(bars: DataFrame) -> DataFrame:
    return percent_rank(bars, "Delta").select(*BAR_KEY, F.col("PercentRank").alias("value"))


def delta_reversal(bars: DataFrame, tail: float = 0.05) -> DataFrame:
    """Extreme delta as a sign of exhaustion."""
    rank: Column = F.col("PercentRank")
    return percent_rank(bars, "Delta").select(
        *BAR_KEY, F.when(rank >= 1 - tail, BUYING_EXHAUSTED).when(rank <= tail, SELLING_EXHAUSTED)
        .otherwise(NO_SIGNAL).alias("value"))

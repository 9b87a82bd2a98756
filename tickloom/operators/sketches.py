"""Profiles of any range of days from sketches that are made once per key and day.

A day's sketch takes some kilobytes whatever the day's rows, and sketches of days merge into that of a range. So a profile of ten years
reads a few thousand rows. Quantiles come from KLL sketches (rank error RANK_ERROR), distinct counts from HyperLogLog
(DISTINCT_ERROR), frequent values from counters that are exact up to TOP_ITEMS * 3 / 4 different values. Count, smallest and
largest value are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import day, named
from tickloom.operators.quantiles import number
from tickloom.schemas import SYMBOL

KLL_SIZE, RANK_ERROR = 800, 0.01
HLL_BITS, DISTINCT_ERROR = 14, 0.03
TOP_ITEMS = 1024
DAY = "trade_date"


def daily_sketches(df: DataFrame, column: str, time: str, keys: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """One row per key and day: n, min, max and three sketches of the column. NULL and NaN do not count.

    Sketches are built map-side, so a busy day sends one per input partition.
    """
    values = df.select(*[named(k) for k in keys], day(time).alias(DAY), number(column).alias("value")).filter("value IS NOT NULL")
    return values.groupBy(*[named(k) for k in keys], DAY).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", KLL_SIZE).alias("kll"), F.hll_sketch_agg(F.col("value").cast("string"), HLL_BITS).alias("hll"),
        F.expr(f"approx_top_k_accumulate(value, {TOP_ITEMS})").alias("top"))


def merged(sketches: DataFrame, keys: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """The sketches of all given days as one row per key; filter days before."""
    return sketches.groupBy(*[named(k) for k in keys]).agg(
        F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("kll", KLL_SIZE).alias("kll"), F.hll_union_agg("hll").alias("hll"),
        F.expr(f"approx_top_k_combine(top, {TOP_ITEMS})").alias("top"))


def profile(merged_sketches: DataFrame, probabilities: Sequence[float], top: int = 5, keys: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """n, min, max, quantiles (in the order of the probabilities), distinct and the `top` most frequent values with their counts."""
    points = F.array(*[F.lit(float(p)) for p in probabilities])
    return merged_sketches.select(
        *[named(k) for k in keys], "n", "min", "max", F.kll_sketch_get_quantile_double("kll", points).alias("quantiles"),
        F.hll_sketch_estimate("hll").alias("distinct"), F.expr(f"approx_top_k_estimate(top, {top})").alias("frequent"))

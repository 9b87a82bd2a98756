"""Flatten, clean, slice and sample volume-by-price tables. All but the slices also run on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import in_time_of_day, quoted
from tickloom.operators.sequence import position_slice, smallest, with_position
from tickloom.schemas import (
    BAR_COLUMNS, BAR_KEY, HELPER_COLUMNS, LEVEL_COLUMNS, PROFILE, SYMBOL, TIME, VENDOR_NAMES,
)


def flatten(bars: DataFrame) -> DataFrame:
    """One row per bar and level; a bar with an empty profile keeps one row of NULL levels.

    Bars and levels live in the same row, so the outer join is a generator and needs no shuffle.
    """
    kept = [quoted(c) for c in bars.columns if c != PROFILE]
    exploded = bars.select(*kept, F.explode_outer(PROFILE).alias("__level"))
    return exploded.select(*kept, *[F.col(f"__level.{c}").alias(c) for c in LEVEL_COLUMNS])


def join_levels(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """Outer join of bars with levels kept in a table of their own."""
    return bars.join(levels, BAR_KEY, "full_outer")


def clean(df: DataFrame, drop: Sequence[str] | None = None) -> DataFrame:
    """Drop helper columns and give vendor columns their names; absent columns are ignored."""
    unwanted = HELPER_COLUMNS if drop is None else drop
    return df.drop(*unwanted).withColumnsRenamed(VENDOR_NAMES)


def to_flat(bars: DataFrame, drop: Sequence[str] | None = None) -> DataFrame:
    return clean(flatten(bars), drop)


def chronological(df: DataFrame) -> DataFrame:
    """Sorted output, for writers that need order."""
    return df.orderBy(*[c for c in (TIME, SYMBOL, "Price") if c in df.columns])


def from_date(df: DataFrame, cutoff: str, time: str = TIME) -> DataFrame:
    return df.filter(F.col(time) >= F.lit(cutoff).cast(df.schema[time].dataType))


def session_hours(df: DataFrame, start: str = "08:00:00", end: str = "15:00:00", time: str = TIME) -> DataFrame:
    return df.filter(in_time_of_day(time, start, end))


def bar_panel(flat: DataFrame) -> DataFrame:
    """Per bar: its columns once, the number of levels and the level table."""
    present = [c for c in BAR_COLUMNS if c in flat.columns]
    level = F.struct(*LEVEL_COLUMNS)
    return flat.groupBy(*BAR_KEY).agg(
        *[F.coalesce(F.any_value(c, True), F.lit(0)).alias(c) for c in present],
        F.count("Price").alias("NumLevels"),
        F.sort_array(F.collect_list(F.when(F.col("Price").isNotNull(), level))).alias("Levels"),
    )


def _order(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in (TIME, "Price", SYMBOL) if c in df.columns]


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(*_order(df)).limit(n)


def tail(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(*[c.desc() for c in _order(df)]).limit(n)


def middle(df: DataFrame, n: int = 5) -> DataFrame:
    """n rows from position len // 2 in (DateTime, Price) order."""
    order = [c for c in (TIME, "Price", SYMBOL) if c in df.columns]
    return position_slice(df, order, F.expr("n_rows div 2"), n)


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """n rows picked by a hash of their key: the same rows on every run and any partitioning.

    Rows are ranked by hash, so `key` should identify a row.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key])
    hashed = df.withColumn("__hash", F.md5(text))
    # 16^4 hash ranges, evenly filled; as numbers, which aggregate by hash
    return smallest(hashed, "__hash", F.conv(F.substring("__hash", 1, 4), 16, 10).cast("int"), n).drop("__hash")


def append_rows(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(new, allowMissingColumns=True)


def seasonality(bars: DataFrame) -> DataFrame:
    """Mean volume by hour of day and day of week (1 = Sunday)."""
    return bars.groupBy(F.hour(TIME).alias("hour"), F.dayofweek(TIME).alias("dow")).agg(
        F.avg("Volume").alias("mean_volume"), F.count(F.lit(1)).alias("n"))


def train_test_split(bars: DataFrame, test: float = 0.2) -> DataFrame:
    """Add `split` by time: the last `test` share of distinct bar times is 'test'.

    Only distinct times and their daily counts meet in a window.
    """
    times = with_position(bars.select(TIME).distinct(), [], TIME, "at", total="n")
    cut = times.filter(F.col("at") <= (1 - F.lit(test)) * (F.col("n") - 1)).agg(F.max(TIME)).scalar()
    return bars.withColumn("split", F.when(F.col(TIME) <= cut, "train").otherwise("test"))

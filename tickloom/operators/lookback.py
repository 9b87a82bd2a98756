"""N-bar lookback on the rows of a volume-by-price table.

The lookback of a bar is an array: entry 0 is t-1, entry 1 is t-2, and so on; a bar near the
start of its symbol has fewer entries. It is computed on bars, not on levels, and every level
row of a bar shares it. An earlier bar is represented by its lowest-priced level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted
from tickloom.operators.reshape import flatten
from tickloom.operators.sequence import framed, join_alike, lagged, with_position
from tickloom.schemas import BAR_KEY, LEVEL_COLUMNS, PROFILE, SYMBOL, TIME

LOOKBACK = 10


def bar_index(bars: DataFrame) -> DataFrame:
    """0-based position of a bar among its symbol's bars."""
    return with_position(bars, [SYMBOL], TIME, out="index")


def bar_heads(flat: DataFrame) -> DataFrame:
    """One row per bar: its lowest-priced row, or the NULL-level row of an empty profile.

    A bar has a price once, so all columns come from one row. A NULL price counts as the highest:
    min_by passes over rows whose order is NULL.
    """
    rest = [c for c in flat.columns if c not in (*BAR_KEY, "Price")]
    order = F.coalesce(F.col("Price").cast("double"), F.lit(float("inf")))
    return flat.groupBy(*BAR_KEY).agg(F.min("Price").alias("Price"), *[F.min_by(quoted(c), order).alias(c) for c in rest])


def entry_struct(bars: DataFrame, columns: Sequence[str] | None) -> Column:
    """What one lookback entry holds: time, the bar's columns and its lowest level."""
    plain = [c for c in bars.columns if c not in (SYMBOL, TIME, PROFILE, "index")]
    fields = {c: F.col(quoted(c)) for c in plain}
    if PROFILE in bars.columns:
        lowest = F.array_min(PROFILE)
        fields.update({c: lowest.getField(c) for c in LEVEL_COLUMNS})
    names = list(fields) if columns is None else list(columns)
    return F.struct(F.col(TIME).alias("timestamp"), *[fields[c].alias(c) for c in names])


def with_lookback(bars: DataFrame, n: int = LOOKBACK, columns: Sequence[str] | None = None,
                  position: str | None = None) -> DataFrame:
    """Add `index` and `lookback` to nested bars or bar heads, one row per symbol and time.

    The entry is built before the window, so that a profile is read once per bar and the frame
    only moves what an entry holds.
    """
    # An `index` that came with the bars may have holes, from a filter say: it counts only where the caller names it.
    placed = bars.withColumn("index", F.col(position)) if position else bar_index(bars.drop("index"))
    placed = placed.withColumn("__entry", entry_struct(bars, columns))
    return framed(
        placed, [SYMBOL], TIME, n, position="index",
        columns=lambda w: {"lookback": F.reverse(F.collect_list("__entry").over(w.rowsBetween(-n, -1)))},
    ).drop("__entry")


def level_lookback(bars: DataFrame, n: int = LOOKBACK, columns: Sequence[str] | None = None) -> DataFrame:
    """Level rows of nested bars, each with its bar's lookback. Levels are never shuffled alone."""
    return flatten(with_lookback(bars, n, columns))


def flat_lookback(flat: DataFrame, n: int = LOOKBACK, columns: Sequence[str] | None = None) -> DataFrame:
    """The same for a table that is already flat: one equi-join of bars and levels."""
    looked = with_lookback(bar_heads(flat), n, columns).select(*BAR_KEY, "index", "lookback")
    return join_alike(flat, looked, BAR_KEY)


def market_records(levels: DataFrame) -> DataFrame:
    """`current` struct (all columns, timestamp, index) and `lookback` array per level row."""
    plain = [c for c in levels.columns if c not in ("index", "lookback")]
    current = F.struct(*[quoted(c) for c in plain], F.col(TIME).alias("timestamp"), F.col("index"))
    return levels.select(current.alias("current"), "lookback")


def current_only(records: DataFrame) -> DataFrame:
    return records.select("current.*")


def close_change(bars: DataFrame) -> DataFrame:
    changed = lagged(bars, [SYMBOL], TIME, {"__previous": "Close"})
    return changed.withColumn("CloseChange", F.col("Close") - F.col("__previous")).drop("__previous")


def mean_volume(bars: DataFrame, n: int = 5) -> DataFrame:
    """Mean volume of t-1 .. t-n; NULL until n earlier bars exist."""
    def columns(window):
        past = window.rowsBetween(-n, -1)
        return {f"AvgVolume{n}": F.when(F.count("Volume").over(past) == n, F.avg("Volume").over(past))}

    return framed(bars, [SYMBOL], TIME, n, columns)


def rvol_alerts(bars: DataFrame, threshold: float = 2.0, rvol_bars: int = 20) -> DataFrame:
    """Bars whose relative volume exceeds the threshold, with their change in close."""
    def columns(window):
        return {
            "RVOL": F.col("Volume") / F.avg("Volume").over(window.rowsBetween(-rvol_bars, -1)),
            "CloseChange": F.col("Close") - F.lag("Close").over(window),
        }

    return framed(bars, [SYMBOL], TIME, rvol_bars, columns).filter(F.col("RVOL") > threshold)


# Fixed value: what the short name stands for in a feature list.
FEATURE_GROUPS = {"OHLCV": ["Open", "High", "Low", "Close", "Volume"]}


def feature_table(bars: DataFrame, features: Sequence[str], n: int = LOOKBACK) -> DataFrame:
    """Chosen features per bar, and the same of t-1 .. t-n as columns t1_Open, t1_High, ..."""
    names = [c for f in features for c in FEATURE_GROUPS.get(f, [f])]
    kept = [*BAR_KEY, *names, *(["index"] if "index" in bars.columns else [])]
    looked = with_lookback(bars.select(*[quoted(c) for c in kept]), n, names)
    past = [F.get("lookback", F.lit(i))[c].alias(f"t{i + 1}_{c}") for i in range(n) for c in names]
    return looked.select(*BAR_KEY, *[quoted(c) for c in names], *past)

"""Duplicate removal inside a table and across batches.

Rows are equal when their value columns are equal, NULL included. The original pipeline ignored
the time of a row, so equal values at different times collapse to the first; `include_time=True`
(the default) keeps them apart. All forms are one grouped aggregate with map-side combine: a row
copied a billion times ships once per input partition, and no join meets a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted
from tickloom.schemas import TIME


def _keys(df: DataFrame, values: Sequence[str] | None, time: str, include_time: bool) -> list[str]:
    chosen = [c for c in (values or df.columns) if c != time]
    return [quoted(c) for c in (chosen + [time] if include_time else chosen)]


def first_occurrences(df: DataFrame, values: Sequence[str] | None = None, time: str = TIME,
                      include_time: bool = True) -> DataFrame:
    """Distinct rows; without the time, each value row keeps its first time."""
    keys = _keys(df, values, time, include_time)
    if include_time:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(F.min(time).alias(time))


def unseen(new: DataFrame, seen: DataFrame, values: Sequence[str] | None = None, time: str = TIME,
           include_time: bool = True) -> DataFrame:
    """Rows of `new`, once each, whose values do not occur in `seen`."""
    keys = _keys(new, values, time, include_time)
    fresh = new.select(*keys, F.col(time).alias("__time"), F.lit(0).alias("__seen"))
    old = seen.select(*keys, F.lit(None).cast(new.schema[time].dataType).alias("__time"), F.lit(1).alias("__seen"))
    merged = fresh.unionByName(old).groupBy(*keys).agg(
        F.max("__seen").alias("__seen"), F.min("__time").alias("__time"))
    kept = merged.filter(F.col("__seen") == 0).drop("__seen")
    return kept.drop("__time") if include_time else kept.withColumnRenamed("__time", time)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in all columns, and their share in percent."""
    groups = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    rows, distinct = F.sum("__n"), F.count(F.lit(1))
    return groups.agg((rows - distinct).cast("bigint").alias("n"),
                      ((rows - distinct) * 100.0 / rows).alias("pct"))

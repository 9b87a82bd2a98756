"""Exact quantiles by radix selection.

The built-in exact `percentile` keeps every distinct value of a column in one hash map. Here doubles are read as 64-bit
numbers in the same order. Around every wanted rank lies an interval of them that holds it; a scan counts the interval's values
in BINS equal parts, with the smallest and largest value of each, and the part that holds the rank is the next interval. A
rank is found when its part has one value only, however often that occurs. Every scan takes 13 bits off, so the smallest and
largest values and five more scans do for any data; mostly two or three do, because parts of few values are counted value
by value. No task sorts a column or holds more than one histogram per interval.

Like `DataFrame.approxQuantile`, these functions run jobs and return a table whose size is the
number of columns times the number of probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import quoted

#: Parts of an interval, and bytes that the histograms of all intervals may take in a task.
BINS, HISTOGRAM_BYTES = 1 << 13, 64 << 20
#: Values of an interval that are counted one by one.
FEW = 4096


def number(name: str) -> Column:
    """A numeric column as double; NaN counts as missing."""
    value = F.col(quoted(name)).cast("double")
    return F.when(~F.isnan(value), value)


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the named numeric columns, without NULLs."""
    rows = df.select(*[number(c).alias(c) for c in columns]).unpivot(
        [], [F.col(quoted(c)) for c in columns], "column", "value")
    return rows.filter(F.col("value").isNotNull())


@dataclass(frozen=True)
class _Interval:
    """Keys from `low` to `high` of a column; `before` values of it are smaller, `count` lie inside."""

    column: int
    low: int
    high: int
    before: int
    count: int


def _value(key: int) -> float:
    """The double of a key, whose order as a signed number is that of the doubles."""
    return float(np.int64(key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF).view(np.float64))


def _scan(values: DataFrame, intervals: Sequence[_Interval], parts: int) -> DataFrame:
    """(interval, part, n, low, high): values of each interval by part, or by value where few are left.

    `values` has the columns c0, c1, ... and the weight w. Keys are sorted per Arrow batch only.
    """
    plain = [(i.column, i.low, i.high) for i in intervals]  # workers need not know this module
    widths = [(i.high - i.low) // parts + 1 for i in intervals]
    few = [i.count <= FEW for i in intervals]

    def count(batches):
        def keys_of(column):
            found = column.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            given = ~np.isnan(found)
            bits = found[given].view(np.int64)
            return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF), given

        counts = [None if f else np.zeros(parts, np.int64) for f in few]
        lows = [None if f else np.full(parts, np.iinfo(np.int64).max) for f in few]
        highs = [None if f else np.full(parts, np.iinfo(np.int64).min) for f in few]
        single: list[dict[int, int]] = [{} for _ in plain]
        for batch in batches:
            weights = batch.column("w").to_numpy(zero_copy_only=False)
            known = {}
            for k, (column, low, high) in enumerate(plain):
                if column not in known:
                    keys, given = keys_of(batch.column(f"c{column}"))
                    order = np.argsort(keys)
                    known[column] = keys[order], np.r_[0, np.cumsum(weights[given][order])]
                keys, upto = known[column]
                a, b = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
                inside = keys[a:b]
                if not len(inside):
                    continue
                if few[k]:
                    at = inside
                else:  # differences of unsigned numbers do not overflow
                    at = ((inside.view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF)) // np.uint64(widths[k])).astype(np.int64)
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                ends = np.r_[starts[1:], len(at)]
                n = upto[a + ends] - upto[a + starts]
                if few[k]:
                    for key, m in zip(inside[starts].tolist(), n.tolist()):
                        single[k][key] = single[k].get(key, 0) + m
                else:
                    cells = at[starts]
                    counts[k][cells] += n
                    lows[k][cells] = np.minimum(lows[k][cells], inside[starts])
                    highs[k][cells] = np.maximum(highs[k][cells], inside[ends - 1])
        for k in range(len(plain)):
            if few[k]:
                at = low = high = np.array(list(single[k]), np.int64)
                n = np.array(list(single[k].values()), np.int64)
            else:
                at = np.flatnonzero(counts[k])
                n, low, high = counts[k][at], lows[k][at], highs[k][at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k), pa.int32()), *[pa.array(x, pa.int64()) for x in (at, n, low, high)]],
                ["interval", "part", "n", "low", "high"])

    return values.mapInArrow(count, "interval int, part bigint, n bigint, low bigint, high bigint")


def _bounds(values: DataFrame, columns: int) -> list[_Interval]:
    """Each column's interval from its smallest to its largest value; columns without values are left out."""
    def ends(batches):
        low, high, total = [None] * columns, [None] * columns, [0] * columns
        for batch in batches:
            weights = batch.column("w").to_numpy(zero_copy_only=False)
            for c in range(columns):
                found = batch.column(f"c{c}").to_numpy(zero_copy_only=False) + 0.0
                given = ~np.isnan(found)
                if given.any():
                    bits = found[given].view(np.int64)
                    keys = bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)
                    low[c] = int(keys.min()) if low[c] is None else min(low[c], int(keys.min()))
                    high[c] = int(keys.max()) if high[c] is None else max(high[c], int(keys.max()))
                    total[c] += int(weights[given].sum())
        rows = [c for c in range(columns) if low[c] is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int32()), *[pa.array([x[c] for c in rows], pa.int64()) for x in (low, high, total)]],
            ["column", "low", "high", "n"])

    found = values.mapInArrow(ends, "column int, low bigint, high bigint, n bigint").groupBy("column").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    return [_Interval(r["column"], r["low"], r["high"], 0, r["n"]) for r in found.collect()]


def _select(values: DataFrame, columns: int, wanted) -> dict[tuple[int, int], float]:
    """{(column, rank): value}; `wanted(column, count)` gives the ranks, from 0, of a column with so many values."""
    found: dict[tuple[int, int], float] = {}
    looking: dict[_Interval, list[int]] = {}

    def keep(interval: _Interval, rank: int) -> None:
        if interval.low == interval.high:
            found[interval.column, rank] = _value(interval.low)
        else:
            looking.setdefault(interval, []).append(rank)

    for interval in _bounds(values, columns):
        for rank in wanted(interval.column, interval.count):
            keep(interval, rank)
    spark = values.sparkSession
    while looking:
        intervals, asked = list(looking), list(looking.values())
        looking = {}
        parts = max(256, min(BINS, HISTOGRAM_BYTES // (24 * len(intervals))))
        totals = _scan(values, intervals, parts).groupBy("interval", "part").agg(
            F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        # At most BINS or FEW rows of an interval meet in a window; one row per wanted rank reaches the driver.
        upto = Window.partitionBy("interval").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = totals.withColumn("upto", F.sum("n").over(upto))
        targets = spark.createDataFrame(
            [(k, rank, rank - i.before) for k, i in enumerate(intervals) for rank in asked[k]], "interval int, rank bigint, at bigint")
        hit = placed.join(F.broadcast(targets), "interval").filter((F.col("at") >= F.col("upto") - F.col("n")) & (F.col("at") < F.col("upto")))
        for r in hit.collect():
            before = intervals[r["interval"]].before + r["upto"] - r["n"]
            keep(_Interval(intervals[r["interval"]].column, r["low"], r["high"], before, r["n"]), r["rank"])
    return found


def _quantiles(values: DataFrame, columns: int, probabilities: Sequence[float]) -> dict[tuple[int, float], float]:
    counts: dict[int, int] = {}

    def ranks(column: int, count: int) -> list[int]:
        counts[column] = count
        return sorted({f(p * (count - 1)) for p in probabilities for f in (math.floor, math.ceil)})

    found = _select(values, columns, ranks)
    result = {}
    for c, count in counts.items():
        for p in probabilities:
            at = p * (count - 1)
            low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
            result[c, p] = low + (high - low) * (at - math.floor(at))
    return result


def quantiles_of_counts(counts: DataFrame, probabilities: Sequence[float]) -> dict[float, float]:
    """{p: quantile} of (value, n) rows, each value counting n times; empty without values."""
    values = counts.select(F.col("value").cast("double").alias("c0"), F.col("n").cast("bigint").alias("w"))
    return {p: q for (_, p), q in _quantiles(values, 1, probabilities).items()}


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> dict[tuple[str, float], float]:
    """{(column, p): quantile}, linearly interpolated; a column without values is left out."""
    values = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(columns)], F.lit(1).cast("bigint").alias("w"))
    return {(columns[c], p): q for (c, p), q in _quantiles(values, len(columns), sorted(set(probabilities))).items()}


def quantile_columns(df: DataFrame, columns: Sequence[str], names: Mapping[str, float]) -> DataFrame:
    """One row per column with a field for each named quantile."""
    found = exact_quantiles(df, list(columns), list(names.values()))
    rows = [(c, *[found.get((c, p)) for p in names.values()]) for c in columns]
    schema = "column string, " + ", ".join(f"`{n}` double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)

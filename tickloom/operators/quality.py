"""Data-quality checks. Counts are aggregates; nothing but the report's few rows reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import micros_between, named
from tickloom.operators.quantiles import quantiles_of_counts
from tickloom.operators.sequence import lagged
from tickloom.schemas import OPTIONAL_COLUMNS, REQUIRED_COLUMNS, SYMBOL, TIME
from tickloom.session import staged
from tickloom.sources.files import read_indexed_csv
from tickloom.sources.sinks import run_summary

ISSUE, WARNING, INFO = "issue", "warning", "info"
GAP_FACTOR = 10
OUTLIER_SIGMAS = 5


def schema_check(df: DataFrame) -> DataFrame:
    """Required columns (issue when absent) and optional ones (warning when absent), with their values counted."""
    wanted = [(c, ISSUE) for c in REQUIRED_COLUMNS] + [(c, WARNING) for c in OPTIONAL_COLUMNS]
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c, _ in wanted if c in df.columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(severity).alias("severity"), F.lit(c in df.columns).alias("present"),
                 (F.col(c) if c in df.columns else F.lit(0)).cast("bigint").alias("n_values"),
                 F.col("__rows").alias("n_rows")) for c, severity in wanted])))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, all_columns: bool = False) -> DataFrame:
    """NULLs per column and their share in percent; only columns that have some, unless asked."""
    chosen = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(named(c).isNull()).alias(c) for c in chosen])
    long = wide.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), named(c).alias("nulls")) for c in chosen])))
    counted = long.select("column", "nulls", (F.col("nulls") * 100.0 / F.col("__rows")).alias("pct"))
    return counted if all_columns else counted.filter(F.col("nulls") > 0)


def bad_ohlc() -> Column:
    """True where the four prices contradict each other; a NULL price contradicts nothing."""
    o, h, l, c = (F.col(n) for n in ("Open", "High", "Low", "Close"))
    return (h < l) | (h < o) | (h < c) | (l > o) | (l > c)


def ohlc_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(bad_ohlc()).alias("n_bad"))


def volume_check(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("Volume") < 0).alias("n_bad"))


@contextmanager
def step_counts(df: DataFrame, grain: str = "bar", chunk: Column | None = None) -> Iterator[DataFrame]:
    """(value, n): how often each step in microseconds occurs between consecutive times of a symbol.

    Grain "level" also counts a step of zero for every row that repeats its symbol's time. The
    distinct times and the counts are staged for the time of the block, so that the table behind them is read once. Times are
    ordered a day at a time; give a finer `chunk` for tables of single trades.
    """
    if grain not in ("bar", "level"):
        raise ValueError("grain is 'bar' or 'level'")
    with staged(df.groupBy(SYMBOL, TIME).agg(F.count(F.lit(1)).alias("rows")), "times") as times:
        steps = lagged(times, [SYMBOL], TIME, {"previous": TIME}, chunk=chunk).filter(F.col("previous").isNotNull())
        counts = steps.groupBy(micros_between("previous", TIME).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        if grain == "level":
            zeros = times.agg(F.lit(0).cast("bigint").alias("value"), F.sum(F.col("rows") - 1).alias("n"))
            counts = counts.unionByName(zeros.filter(F.col("n") > 0)).groupBy("value").agg(F.sum("n").alias("n"))
        with staged(counts, "steps") as found:
            yield found


def gap_check(df: DataFrame, grain: str = "bar", factor: int = GAP_FACTOR,
              chunk: Column | None = None) -> DataFrame:
    """Steps longer than `factor` times the median step.

    Grain "bar" looks at distinct times; "level" takes every row as a step, as the original check
    did, which makes the median zero wherever bars have more than two levels.
    """
    with step_counts(df, grain, chunk) as counts:
        median = quantiles_of_counts(counts, [0.5]).get(0.5)
        middle = F.lit(median).cast("double")
        is_gap = F.col("value") > middle * factor
        found = counts.agg(
            F.coalesce(F.sum(F.when(is_gap, F.col("n"))), F.lit(0)).cast("bigint").alias("n_gaps"),
            F.max(middle / 1e6).alias("median_s"),
            (F.max(F.when(is_gap, F.col("value"))) / 1e6).alias("max_gap_s"),
        )
        return df.sparkSession.createDataFrame(found.collect(), found.schema)  # one row


def _beyond(column: str, mean: float | None, std: float | None, sigmas: float) -> Column:
    low, high = (None, None) if mean is None or std is None else (mean - sigmas * std, mean + sigmas * std)
    value = F.col(column)
    return (value > F.lit(high).cast("double")) | (value < F.lit(low).cast("double"))


def outlier_check(df: DataFrame, column: str = "Close", sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """Rows further than `sigmas` sample standard deviations from the mean."""
    mean, std = df.agg(F.avg(column), F.stddev_samp(column)).first()
    return df.agg(F.count_if(_beyond(column, mean, std, sigmas)).alias("n"),
                  F.max(F.lit(mean)).cast("double").alias("mean"), F.max(F.lit(std)).cast("double").alias("std"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of every key."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"))


def backward_steps(df: DataFrame, sequence: str, time: str, block: int = 65_536) -> DataFrame:
    """Rows whose time is earlier than that of the row before them in arrival order.

    `sequence` is a whole number that gives the arrival order. Blocks of it are compared inside; across blocks only
    their first and last rows meet, first inside `block` blocks, then of those. The last window sees a row for
    every block * block numbers.
    """
    def joined(parts: DataFrame, *group: str) -> DataFrame:
        back = F.col("first") < F.lag("last").over(Window.partitionBy(*group).orderBy("at"))
        stepped = parts.withColumn("steps", F.col("steps") + F.coalesce(back.cast("bigint"), F.lit(0)))
        return stepped.groupBy(*group).agg(
            F.sum("steps").alias("steps"), F.min_by("first", "at").alias("first"), F.max_by("last", "at").alias("last"))

    parts = df.select(F.col(sequence).alias("at"), F.col(time).alias("first"), F.col(time).alias("last"),
                      F.lit(0).cast("bigint").alias("steps"))
    for _ in range(2):
        parts = joined(parts.withColumn("group", F.floor(F.col("at") / block)), "group").withColumnRenamed("group", "at")
    return joined(parts).select(F.coalesce("steps", F.lit(0)).cast("bigint").alias("n_backward_steps"))


REPORT = "check string, severity string, column string, n bigint, pct double, detail string"


def report(df: DataFrame, grain: str = "bar") -> DataFrame:
    """All findings as rows (check, severity, column, n, pct, detail); checks that pass add none.

    Three passes over the table: one aggregate for counts and moments, one for the outliers that
    need those moments, one that reduces it to its time steps. The report itself is a few rows.
    """
    have = set(df.columns)
    rows: list[tuple] = [
        ("required_columns" if severity == ISSUE else "optional_columns", severity, c, 1, None, None)
        for names, severity in ((REQUIRED_COLUMNS, ISSUE), (OPTIONAL_COLUMNS, WARNING))
        for c in names if c not in have
    ]
    counts = {f"null {i}": F.count_if(named(c).isNull()) for i, c in enumerate(df.columns)}
    counts["rows"] = F.count(F.lit(1))
    if {"Open", "High", "Low", "Close"} <= have:
        counts["ohlc"] = F.count_if(bad_ohlc())
    if "Volume" in have:
        counts["volume"] = F.count_if(F.col("Volume") < 0)
    if "Close" in have:
        counts["mean"], counts["std"] = F.avg("Close"), F.stddev_samp("Close")
    found = df.agg(*[c.alias(name) for name, c in counts.items()]).first().asDict()
    for i, c in enumerate(df.columns):
        if found[f"null {i}"]:
            share = found[f"null {i}"] * 100.0 / found["rows"]
            rows.append(("nulls", WARNING, c, found[f"null {i}"], share, None))
    for check, column in (("ohlc", None), ("volume", "Volume")):
        if found.get(check):
            rows.append((check, ISSUE, column, found[check], None, None))
    if {SYMBOL, TIME} <= have:
        gaps = gap_check(df, grain).first()
        if gaps["n_gaps"]:
            detail = f"median {gaps['median_s']:g} s, largest {gaps['max_gap_s']:g} s"
            rows.append(("gaps", WARNING, TIME, gaps["n_gaps"], None, detail))
    if "Close" in have:
        far = _beyond("Close", found["mean"], found["std"], OUTLIER_SIGMAS)
        outliers = df.agg(F.count_if(far)).first()[0]
        if outliers:
            rows.append(("outliers", WARNING, "Close", outliers, None, None))
    return df.sparkSession.createDataFrame(rows, REPORT)


def verdict(report_rows: DataFrame) -> bool:
    """True when the report holds no issue."""
    return report_rows.filter(F.col("severity") == ISSUE).isEmpty()


def validate_path(spark: SparkSession, path: str, grain: str = "bar") -> tuple[DataFrame, bool]:
    """Report on CSV files whose first column is the time, and whether they pass.

    The first row (check `table`) tells rows, columns and the range of times; an empty table has no range.
    """
    df = read_indexed_csv(spark, path)
    seen, found = run_summary(df).first(), report(df, grain)
    span = f"{seen['columns']} columns, {seen['min_ts']} to {seen['max_ts']}" if seen["min_ts"] else f"{seen['columns']} columns"
    head = spark.createDataFrame([("table", INFO, None, seen["rows"], None, span)], REPORT)
    return head.union(found), verdict(found)


def quarantine(raw: DataFrame, time: str = TIME, price: str = "Price", volume: str = "TotalVolume") -> DataFrame:
    """Text rows to typed rows, with the reason why a row cannot be used ('ok' when it can)."""
    parsed = raw.select(
        "*",
        F.expr(f"try_cast(`{time}` AS timestamp_ntz)").alias("__time"),
        F.expr(f"try_cast(`{price}` AS double)").alias("__price"),
        F.expr(f"try_cast(`{volume}` AS bigint)").alias("__volume"),
    )
    reason = (
        F.when(F.col("__time").isNull(), "bad_time")
        .when(F.col("__price").isNull() & F.col(price).isNotNull(), "bad_price")
        .when(F.col(volume).isNotNull() & (F.col("__volume").isNull() | (F.col("__volume") < 0)), "bad_volume")
        .otherwise("ok")
    )
    rest = [F.col(f"`{c}`") for c in raw.columns if c not in (time, price, volume)]
    return parsed.select(*rest, F.col("__time").alias(time), F.col("__price").alias(price),
                         F.col("__volume").alias(volume), reason.alias("reason"))

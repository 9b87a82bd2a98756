"""Column profiling: the tables behind a statistical report.

Whole-table statistics of all columns come from one wide aggregate; per-column bounds are then
joined back to (column, value) rows by column name, one small row per column.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import columns_with_role, named, nan_to_null, numeric_columns, text_columns, time_columns
from tickloom.operators.dedup import duplicate_count
from tickloom.operators.quantiles import exact_quantiles, long_form, number, quantile_columns
from tickloom.operators.quality import null_counts
from tickloom.schemas import BINS, HIGH_CORRELATION, IQR_REACH, SKEW_LABELS, TAIL_LABELS, Z_LIMIT

Stat = Callable[[Column], Column]


def wide_stats(df: DataFrame, columns: Sequence[str], stats: Mapping[str, Stat]) -> DataFrame:
    """(column, rows, stat...) rows out of one scan.

    The statistics are written once for (column, value) rows, however many columns there are: an aggregate with all of them for
    all columns side by side is more than Spark compiles. Each task sends one row per column.
    """
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), number(c).alias("value"), F.lit(1).alias("row")) for c in columns])))
    # One row more per column, which counts nothing, so that a table without rows has statistics too
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").select(
        "column", F.lit(None).cast("double").alias("value"), F.lit(0).alias("row"))
    return values.unionByName(every).groupBy("column").agg(
        F.sum("row").alias("rows"), *[make(F.col("value")).alias(name) for name, make in stats.items()])


def _known(stats: DataFrame) -> DataFrame:
    """A table of one row per column, computed now: what reads it several times scans once."""
    return stats.sparkSession.createDataFrame(stats.collect(), stats.schema)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(c).cast("double")
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below four values."""
    n = F.count(c).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


# -- missing values, shape, uniqueness ---------------------------------------------------------

def missing(df: DataFrame) -> DataFrame:
    return null_counts(df).withColumnRenamed("nulls", "n").orderBy(F.col("n").desc(), "column")


def missing_totals(df: DataFrame) -> DataFrame:
    gaps = [named(c).isNull() for c in df.columns]
    any_gap = gaps[0]
    count = gaps[0].cast("int")
    for g in gaps[1:]:
        any_gap, count = any_gap | g, count + g.cast("int")
    rows = F.count(F.lit(1))
    return df.agg(
        F.sum(count.cast("bigint")).alias("total"),
        ((1 - F.count_if(any_gap) / rows) * 100).alias("complete_pct"),
        (F.sum(count.cast("bigint")) * 100.0 / (rows * len(df.columns))).alias("overall_pct"),
    )


def overview(df: DataFrame) -> DataFrame:
    kinds = {"numeric": numeric_columns(df), "text": text_columns(df), "time": time_columns(df)}
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        *[F.lit(len(names)).cast("bigint").alias(f"{kind}_columns") for kind, names in kinds.items()])


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def uniqueness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct values per column, NULL and NaN left out. Counted as grouped values, so no task holds a column."""
    chosen = list(columns or numeric_columns(df))
    values = nan_to_null(df.select(*[named(c) for c in chosen])).select(*[named(c).cast("string").alias(c) for c in chosen]).unpivot(
        [], [named(c) for c in chosen], "column", "value")
    per_value = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.create_map(*[F.lit(x) for c, kind in df.dtypes if c in chosen for x in (c, kind)])
    return per_value.groupBy("column").agg(
        F.count("value").alias("n_unique"), (F.count("value") / F.sum("n")).alias("ratio")).withColumn("dtype", kinds[F.col("column")])


def categorical(df: DataFrame, columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """Distinct values and the most frequent ones of the text columns."""
    chosen = list(columns or text_columns(df))
    values = df.select(*[named(c) for c in chosen]).unpivot([], [named(c) for c in chosen], "column", "value")
    # Both uses below read the same rows and columns, so Spark shuffles the values once for both.
    known = values.filter(F.col("column").isNotNull() & F.col("value").isNotNull())
    per_value = known.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    unique = per_value.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
    common = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    best = per_value.withColumn("rank", F.row_number().over(common)).filter(F.col("rank") <= top)
    return best.drop("rank").join(F.broadcast(unique), "column")


def duplicates(df: DataFrame) -> DataFrame:
    return duplicate_count(df)


# -- moments and quantiles -------------------------------------------------------------------

def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return wide_stats(df, columns or numeric_columns(df), {
        "skewness": sample_skewness, "kurtosis": sample_kurtosis, "variance": F.var_samp,
        "std": F.stddev_samp, "range": lambda c: F.max(c) - F.min(c),
    }).drop("rows")


def quantiles(df: DataFrame, columns: Sequence[str] | None = None,
              names: Mapping[str, float] | None = None) -> DataFrame:
    wanted = names or {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}
    return quantile_columns(df, columns or numeric_columns(df), wanted)


def _by_column(left: DataFrame, right: DataFrame) -> DataFrame:
    # Both sides hold one row per table column.
    return left.join(F.broadcast(right), "column")


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = list(columns or numeric_columns(df))
    basics = wide_stats(df, chosen, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}).drop("rows")
    return _by_column(basics, quantiles(df, chosen, {"q25": 0.25, "q50": 0.5, "q75": 0.75}))


def extremes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = list(columns or numeric_columns(df))
    ends = wide_stats(df, chosen, {"min": F.min, "max": F.max}).drop("rows")
    return _by_column(ends, quantiles(df, chosen, {"p1": 0.01, "p99": 0.99}))


def shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    stats = wide_stats(df, columns or numeric_columns(df), {
        "skewness": sample_skewness, "kurtosis": sample_kurtosis, "zeros": lambda c: F.count_if(c == 0)})
    return stats.select(
        "column", "skewness", skew_label(F.col("skewness")).alias("skew_label"),
        "kurtosis", tail_label(F.col("kurtosis")).alias("tail_label"),
        "zeros", (F.col("zeros") * 100.0 / F.col("rows")).alias("zeros_pct"))


def skew_label(skew: Column) -> Column:
    """Exactly 0.5 and NULL fall through to the last label, as in the original report."""
    return (F.when(F.abs(skew) < 0.5, SKEW_LABELS["middle"])
            .when(skew > 0.5, SKEW_LABELS["right"]).otherwise(SKEW_LABELS["left"]))


def tail_label(kurtosis: Column) -> Column:
    return (F.when(kurtosis > 3, TAIL_LABELS["heavy"]).when(kurtosis < -1, TAIL_LABELS["light"])
            .otherwise(TAIL_LABELS["middle"]))


def feature_flags(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    stats = wide_stats(df, columns or numeric_columns(df), {
        "variance": F.var_samp, "mean": F.avg, "skewness": sample_skewness})
    return stats.select(
        "column", (F.col("variance") > F.col("mean")).alias("high_var"),
        (F.abs("skewness") > 1).alias("skewed"), (F.col("variance") == 0).alias("constant"))


# -- distributions ---------------------------------------------------------------------------

def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are kept."""
    chosen = list(columns or numeric_columns(df))
    rows = long_form(df, chosen)
    ends = _known(wide_stats(df, chosen, {"lo": F.min, "hi": F.max, "total": F.count}).filter("total > 0"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select("column", "total", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (rows.join(F.broadcast(ends), "column")
              .groupBy("column", F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    step = (F.col("hi") - F.col("lo")) / bins
    grid = ends.select("column", "lo", "hi", "total",
                       F.explode(F.sequence(*[F.lit(i).cast("bigint") for i in (0, bins - 1)])).alias("bin"))
    filled = grid.join(counts, ["column", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(
        "column", "bin", (F.col("lo") + F.col("bin") * step).alias("lo"),
        (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"), "n",
        (F.col("n") / F.col("total") / step).alias("density"))


def _fences(quartiles: DataFrame) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    return quartiles.select("*", (F.col("q1") - IQR_REACH * spread).alias("lower"),
                            (F.col("q3") + IQR_REACH * spread).alias("upper"))


def fences(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fences(quantiles(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}))


def boxplot(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers at the last value inside 1.5 IQR, and the number of values beyond."""
    chosen = list(columns or numeric_columns(df))
    v = F.col("value")
    inside = (v >= F.col("lower")) & (v <= F.col("upper"))
    return (long_form(df, chosen).join(F.broadcast(fences(df, chosen)), "column")
            .groupBy("column", "q1", "median", "q3").agg(
                F.min(F.when(v >= F.col("lower"), v)).alias("whisker_lo"),
                F.max(F.when(v <= F.col("upper"), v)).alias("whisker_hi"),
                F.count_if(~inside).alias("n_fliers")))


def normal_curve(df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Normal density with the column's mean and deviation at evenly spaced points."""
    c = number(column)
    stats = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi"))
    steps = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / (points - 1))
    at = steps.withColumn("x", x)
    z = (F.col("x") - F.col("m")) / F.col("s")
    return at.select("x", (F.exp(-0.5 * z * z) / (F.col("s") * F.sqrt(2 * F.pi()))).alias("pdf"))


def qq(df: DataFrame, column: str, points: int = 99) -> DataFrame:
    """Sample quantiles on a fixed grid of probabilities next to those of a standard normal."""
    grid = [(i + 1) / (points + 1) for i in range(points)]
    found = exact_quantiles(df, [column], grid)
    rows = [(p, found.get((column, p)), NormalDist().inv_cdf(p)) for p in grid]
    return df.sparkSession.createDataFrame(rows, "p double, sample_q double, normal_q double")


# -- relations -------------------------------------------------------------------------------

def pearson(x: Column, y: Column) -> Column:
    """Pearson r of rows that have both; NULL below two of them, NaN, as in SQL engines, if one side has one value only.

    F.corr divides by zero there, an error in ANSI mode. Deviations that are merged from several tasks need not be exactly
    zero, so equal values are told by their ends.
    """
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (spread > 0)
    return F.when(F.count(x) > 1, F.when(varies, F.covar_pop(x, y) / spread).otherwise(F.lit(float("nan"))))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson r of every pair of table columns over rows where both are present.

    Each row gives one row per pair, and the aggregate is that of one pair. So one scan does for any number of columns,
    and what Spark compiles stays small. Only the names are broadcast: a broadcast of the correlations would have the whole
    scan inside it, and Spark gives up a broadcast after some minutes.
    """
    chosen = list(columns or numeric_columns(df))
    wanted = [(i * len(chosen) + j, chosen[i], chosen[j]) for i in range(len(chosen)) for j in range(i + 1, len(chosen))]
    names = df.sparkSession.createDataFrame(wanted, "pair int, col_a string, col_b string")
    pairs = F.array(*[F.lit(k) for k, _, _ in wanted]).cast("array<int>")
    values = df.select(F.array(*[number(c) for c in chosen]).alias("values")).select("values", F.explode(pairs).alias("pair"))
    place = {"x": F.expr(f"pair div {max(len(chosen), 1)}"), "y": F.col("pair") % max(len(chosen), 1)}
    rows = values.select("pair", *[F.get("values", at.cast("int")).alias(side) for side, at in place.items()]).dropna()
    found = rows.groupBy("pair").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    # One row more per pair, so that one without rows is there too; added before the aggregate it would slow the scan
    found = found.unionByName(names.select("pair", F.lit(None).cast("double").alias("r"))).groupBy("pair").agg(F.max("r").alias("r"))
    return found.join(F.broadcast(names), "pair").select("col_a", "col_b", "r")


def high_correlation(df: DataFrame, columns: Sequence[str] | None = None,
                     limit: float = HIGH_CORRELATION) -> DataFrame:
    return correlation(df, columns).filter(F.abs("r") > limit).orderBy(F.abs("r").desc())


def pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The numeric columns, rows with a NULL left out."""
    chosen = list(columns or numeric_columns(df))
    return df.select(*[named(c) for c in chosen]).na.drop()


def price_volume(df: DataFrame) -> DataFrame:
    """The first column with the role of a price against the first with that of a volume, rows with both; both are named in the result."""
    found = {role: columns_with_role(df.select(*[named(c) for c in numeric_columns(df)]), role) for role in ("price", "volume")}
    if not all(found.values()):
        raise ValueError(f"no numeric column for {[r for r, c in found.items() if not c]}")
    price, volume = found["price"][0], found["volume"][0]
    return df.select(F.lit(price).alias("price_column"), number(price).alias("price"), F.lit(volume).alias("volume_column"),
                     number(volume).alias("volume")).na.drop()


def timeseries(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.select(named(time).cast("timestamp_ntz").alias("t"), named(value).alias("v")).orderBy("t", "v")


# -- outliers --------------------------------------------------------------------------------

def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = list(columns or numeric_columns(df))
    v = F.col("value")
    return (long_form(df, chosen).join(F.broadcast(fences(df, chosen)), "column")
            .filter((v < F.col("lower")) | (v > F.col("upper"))).select("column", "value"))


def z_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = Z_LIMIT) -> DataFrame:
    chosen = list(columns or numeric_columns(df))
    stats = wide_stats(df, chosen, {"mean": F.avg, "std": F.stddev_samp}).drop("rows")
    z = F.abs(F.col("value") - F.col("mean")) / F.col("std")
    return (long_form(df, chosen).join(F.broadcast(stats), "column")
            .filter((F.col("std") > 0) & (z > limit)).select("column", "value", z.alias("z")))


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Outliers by both methods per column, as counts and percent of all rows."""
    chosen = list(columns or numeric_columns(df))
    stats = wide_stats(df, chosen, {"mean": F.avg, "std": F.stddev_samp})
    bounds = _by_column(stats, fences(df, chosen))
    v = F.col("value")
    beyond = (v < F.col("lower")) | (v > F.col("upper"))
    far = (F.col("std") > 0) & (F.abs(v - F.col("mean")) / F.col("std") > Z_LIMIT)
    counted = (long_form(df, chosen).join(F.broadcast(bounds), "column")
               .groupBy("column", "rows", "lower", "upper")
               .agg(F.count_if(beyond).alias("iqr_n"), F.count_if(far).alias("z_n")))
    return counted.select(
        "column", "iqr_n", (F.col("iqr_n") * 100.0 / F.col("rows")).alias("iqr_pct"),
        "z_n", (F.col("z_n") * 100.0 / F.col("rows")).alias("z_pct"), "lower", "upper")

"""Batch writers. All of them write in parallel and let Spark commit the files."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.columns import day, quoted, time_text
from tickloom.schemas import SYMBOL, TIME
from tickloom.session import checkpoint_location
from tickloom.sources.folders import matching, remove

FORMATS = ("csv", "parquet")


def write_csv(df: DataFrame, path: str) -> str:
    """Overwrite; times keep the format the reader expects."""
    text = df.withColumn(TIME, time_text()) if TIME in df.columns else df
    text.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_features(df: DataFrame, path: str | None = None, fmt: str = "csv", folder: str | None = None) -> str:
    """Write features; parquet is laid out by symbol and date, so later reads prune both.

    Without a path the file gets a name with the time, in `folder` or the shared folder's `features`.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")
    if path is None:
        path = f"{folder or checkpoint_location(df.sparkSession, 'features')}/features_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}.{fmt}"
    if fmt == "csv":
        return write_csv(df, path)
    parts = [c for c in (SYMBOL, "trade_date") if c == "trade_date" or c in df.columns]
    out = df.withColumn("trade_date", day(TIME))
    # Ranges on (symbol, time) split a hot symbol over many files instead of one writer.
    order = [SYMBOL, TIME] if SYMBOL in df.columns else [TIME]
    (out.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").partitionBy(*parts).parquet(path))
    return path


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number of the newest complete manifest and the run that holds each day; (0, {}) for a new export."""
    versions = {int(p.split("version=")[1].split("/")[0]): p for p in matching(spark, f"{path}/_manifest/version=*/_SUCCESS")}
    if not versions:
        return 0, {}
    newest = max(versions)
    rows = spark.read.schema("day string, run string").parquet(versions[newest].rsplit("/", 1)[0]).collect()  # one row per day
    return newest, {r["day"]: r["run"] for r in rows}


def export_days(df: DataFrame, path: str) -> int:
    """Write rows by day and symbol; whole days that were exported before are replaced, all other days stay.

    Rows go to a run's own folder first. The export changes when the next manifest, which names the run of every day, is complete;
    a crash before that leaves it as it was. Folders of runs that no day needs are removed behind that. Returns the
    manifest's number. Rows without a time have a day of their own.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    parts = [c for c in ("trade_date", SYMBOL) if c == "trade_date" or c in df.columns]
    order = [quoted(c) for c in (SYMBOL, TIME) if c in df.columns]
    out = df.withColumn("trade_date", F.coalesce(day(TIME).cast("string"), F.lit("none")))
    out.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(*parts).parquet(f"{path}/run={run}")
    number, days = _manifest(spark, path)
    written = [p.rsplit("trade_date=", 1)[1].rstrip("/") for p in matching(spark, f"{path}/run={run}/trade_date=*")]
    days.update({d: run for d in written})
    spark.createDataFrame(sorted(days.items()), "day string, run string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/_manifest/version={number + 1}")
    for folder in matching(spark, f"{path}/run=*"):
        if folder.rstrip("/").rsplit("run=", 1)[1] not in days.values():
            remove(spark, folder)
    return number + 1


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an export as its newest manifest has them; filters on trade_date and symbol read their folders only."""
    _, days = _manifest(spark, path)
    if not days:
        raise ValueError(f"no export in {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/run={r}/trade_date={d}" for d, r in sorted(days.items())]).drop("run")


def write_bar_table(df: DataFrame, table: str, buckets: int = 64) -> None:
    """Bars bucketed by key: aggregates by (symbol, DateTime) and plain joins on it then need no shuffle."""
    (df.write.mode("overwrite").format("parquet")
        .bucketBy(buckets, SYMBOL, TIME).sortBy(SYMBOL, TIME).saveAsTable(table))


def run_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.min(TIME).alias("min_ts"),
        F.max(TIME).alias("max_ts"),
    )


def data_info(df: DataFrame, mode: str = "training") -> dict:
    """Mode, shape, columns, range and the first five rows, for a report."""
    stats = run_summary(df).first()
    order = [quoted(c) for c in (TIME, "Price") if c in df.columns]
    return {
        "mode": mode, "shape": (stats["rows"], stats["columns"]), "columns": list(df.columns),
        "date_range": (stats["min_ts"], stats["max_ts"]),
        "head": [r.asDict(recursive=True) for r in df.orderBy(*order).limit(5).collect()],
    }

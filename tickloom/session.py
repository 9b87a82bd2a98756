"""Session settings this library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", name: str = "tickloom", partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benches; on a cluster the job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "12g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only where none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tickloom-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint_location(spark: SparkSession, label: str | None = None) -> str:
    """A stream's own folder below the shared root; a stable label lets it resume."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label or uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str = "stage", **options: str) -> str:
    """Write a table to a new folder below the shared one; returns the folder."""
    path = checkpoint_location(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return path


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write a reduced table to the shared folder and read it back.

    For tables that later steps read several times: the input behind them is then scanned once,
    and a lost executor costs a re-read of this table, not of the input.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_stage(df, label))


@contextmanager
def staged(df: DataFrame, label: str = "stage") -> Iterator[DataFrame]:
    """A table written to the shared folder for the time of a block, and removed behind it."""
    from tickloom.sources.folders import remove

    path = write_stage(df, label)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        remove(df.sparkSession, path)

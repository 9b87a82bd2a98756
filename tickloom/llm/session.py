"""Reading the given tables, and letting Python workers find this package."""

from __future__ import annotations

import gc
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tickloom


def find_package(spark: SparkSession) -> None:
    """Let Python workers look for this package where the driver found it, whatever folder they start in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(tickloom.__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps.

    Spark drops them when the driver collects the plans that made them, which a driver with memory to spare may not do for
    hours. Called after a step has been written to the shared folder, so nothing that is still needed goes.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shielded(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with columns that begin with `__`, as this package's own do, under free names, and a function that gives the names back."""
    taken = {c.lower() for c in df.columns}
    changed = {}
    for k, name in enumerate(c for c in df.columns if c.startswith("__")):
        free = f"given{k}"
        while free in taken:
            free += "_"
        taken.add(free)
        changed[name] = free
    back = {free: name for name, free in changed.items()}
    return df.withColumnsRenamed(changed), lambda out: out.withColumnsRenamed(back)

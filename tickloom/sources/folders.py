"""Folders on whatever file system a path names, seen from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Existing paths that fit a pattern, sorted; none if there is no such folder."""
    files, where = _opened(spark, pattern)
    return sorted(s.getPath().toString() for s in files.globStatus(where) or [])


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote, with all in it; one that is gone is no error."""
    files, where = _opened(spark, path)
    files.delete(where, True)

"""History files, nested bars, and the one entry that accepts any of them."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from enum import Enum
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import nan_to_null, named, quoted
from tickloom.schemas import (
    DATETIME_FORMAT, FLAT_VBP_TEXT, LEVEL, LEVEL_COLUMNS, PROFILE, RAW_BAR, TIME,
)


class Mode(Enum):
    TRAINING = "training"
    LIVE = "live"
    AUTO = "auto"


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself, or an error naming what is missing."""
    if not hasattr(df, "schema"):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def parse_time(df: DataFrame, column: str = TIME, strict: bool = True) -> DataFrame:
    """Text times to timestamps: strict raises on bad text, tolerant gives NULL."""
    text = named(column).cast("string")
    if strict:
        parsed = F.to_timestamp_ntz(text, F.lit(DATETIME_FORMAT))
    else:
        parsed = F.expr(f"try_cast(CAST({quoted(column)} AS STRING) AS timestamp_ntz)")
    return require_columns(df, column).withColumn(column, parsed)


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, opened as Spark would open it; None for an empty one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
    stream = where.getFileSystem(conf).open(where)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine()
    finally:
        stream.close()
    return None if line is None else line.removeprefix("\ufeff")


def header_groups(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """CSV files by their header, in the order of the files. Reads one line of each; empty files are left out."""
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(files, lines):
        if line is not None:
            groups.setdefault(tuple(next(csv.reader([line]), [])), []).append(file)
    for header in groups:
        if len(set(header)) < len(header):
            raise ValueError(f"a header names a column twice: {list(header)}")
    return groups


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under all columns, matched by name; columns of different number types become doubles, other mixtures text."""
    kinds: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema.fields:
            if field.dataType not in kinds.setdefault(field.name, []):
                kinds[field.name].append(field.dataType)
    target = {c: "double" if all(isinstance(k, T.NumericType) for k in ks) else "string" for c, ks in kinds.items() if len(ks) > 1}
    same = [f.select(*[named(c).cast(target[c]).alias(c) if c in target else named(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), same)


def _present(schema: T.StructType, header: Sequence[str]) -> T.StructType:
    known = {f.name: f for f in schema.fields}
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])


def _groups(spark: SparkSession, path, index: str | None = TIME) -> Iterator[tuple[tuple[str, ...], list[str]]]:
    groups = header_groups(spark, path)
    if not groups:
        raise ValueError(f"no CSV file with a header in {path}")
    for header, files in groups.items():
        if index is not None and index not in header:
            raise ValueError(f"missing columns: ['{index}'] in {files[0]}")
        yield header, files


def read_history_csv(spark: SparkSession, path, schema: T.StructType | None = FLAT_VBP_TEXT,
                     strict: bool = True) -> DataFrame:
    """A flat history with a DateTime column. schema=None infers types (ad-hoc files only).

    Files are grouped by their header, each group is read under its own, and rows meet by column name: files may differ in the
    order and number of columns, and a column that a file lacks is NULL. With strict=False a cell that is no number or time is NULL;
    `split_history_csv` sets such rows aside. The result is not sorted: operators order by DateTime where they need it, and
    `reshape.chronological` sorts an output. A global sort here would only cost a shuffle.
    """
    frames = []
    for header, files in _groups(spark, path):
        reader = spark.read.option("header", True)
        if schema is None:
            frames.append(reader.option("inferSchema", True).csv(files))
        else:
            frames.append(reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(_present(schema, header)).csv(files))
    return nan_to_null(parse_time(united(frames), strict=strict))


def read_indexed_csv(spark: SparkSession, path, schema: T.StructType = FLAT_VBP_TEXT) -> DataFrame:
    """First column is the time index, read leniently, whatever its name; known columns have their types, others are text.

    Headers may differ as in `read_history_csv`. Nothing is inferred, so data is read once.
    """
    frames = []
    for header, files in _groups(spark, path, None):
        if TIME in header[1:]:
            raise ValueError(f"{TIME} is not the first column of {files[0]}")
        names = (TIME, *header[1:])
        frames.append(spark.read.option("header", True).schema(_present(schema, names)).csv(files))
    return nan_to_null(parse_time(united(frames), strict=False))


#: Columns of set-aside rows: the file, the line as it stands there, and what is wrong with it.
REJECT = ["file", "line", "reason"]
_LINE, _EXTRA = "__line", "__extra"


def _judged(spark: SparkSession, files: Sequence[str], present: T.StructType) -> DataFrame:
    """Parsed rows of files with one header, and for each that cannot be used the names of its bad columns.

    Lines are taken apart as text, so that every one can be given back as it stands. A line that repeats the header is one.
    """
    names = [f.name for f in present.fields]
    cells = F.from_csv("value", F.lit(", ".join(f"{quoted(c)} string" for c in [*names, _EXTRA])), {"columnNameOfCorruptRecord": _EXTRA})
    lines = spark.read.text(list(files)).select(F.col("_metadata.file_path").alias("__file"), F.col("value").alias(_LINE), cells.alias("c"))
    cell = {c: F.col("c").getField(c) for c in names}
    title = reduce(lambda x, y: x & y, [F.regexp_replace(cell[c], "^\\ufeff", "").eqNullSafe(F.lit(c)) for c in names])
    data = lines.filter((F.trim(_LINE) != "") & ~title)
    typed = {f.name: cell[f.name].try_cast("timestamp_ntz" if f.name == TIME else f.dataType) for f in present.fields}
    bad = F.concat_ws(", ", F.when(typed[TIME].isNull(), F.lit(TIME)), *[
        F.when(cell[c].isNotNull() & typed[c].isNull(), F.lit(c)) for c in names if c != TIME])
    reason = F.when(F.col("c").getField(_EXTRA).isNotNull(), F.lit("number of fields")).when(bad != "", bad)
    return data.select(*[typed[c].alias(c) for c in names], "__file", _LINE, reason.alias("__reason"))


def split_history_csv(spark: SparkSession, path, target: str, schema: T.StructType = FLAT_VBP_TEXT) -> tuple[DataFrame, DataFrame]:
    """Write a history's rows to `target`, good ones and set-aside ones apart, in one pass; returns both tables.

    A row is set aside if it has no readable time, a cell that its column's type does not take, or more or fewer fields than its
    file's header. Set-aside rows have the columns of REJECT.
    """
    frames = [_judged(spark, files, _present(schema, header)) for header, files in _groups(spark, path)]
    rows = nan_to_null(united(frames)).withColumn("rejected", F.col("__reason").isNotNull())
    rows.write.mode("overwrite").partitionBy("rejected").parquet(target)
    back = spark.read.schema(rows.schema).parquet(target)
    names = [c for c in rows.columns if c not in ("__file", _LINE, "__reason", "rejected")]
    good = back.filter(~F.col("rejected")).select(*[named(c) for c in names])
    return good, back.filter("rejected").select(F.col("__file").alias("file"), F.col(_LINE).alias("line"), F.col("__reason").alias("reason"))


def read_bars(spark: SparkSession, path, fmt: str = "parquet", schema: T.StructType = RAW_BAR) -> DataFrame:
    """Nested bars as the vendor delivers them (one row per bar, profile as array)."""
    return nan_to_null(spark.read.format(fmt).schema(schema).load(path))


def levels_from_lists(df: DataFrame, column: str = PROFILE) -> DataFrame:
    """Positional [[price, bid, ask, total, trades], ...] to named level structs."""
    item = df.schema[column].dataType.elementType
    if isinstance(item, T.StructType):
        return df
    kinds = {f.name: f.dataType for f in LEVEL.fields}
    return df.withColumn(column, F.transform(column, lambda v: F.struct(*[
        F.get(v, F.lit(i)).cast(kinds[name]).alias(name) for i, name in enumerate(LEVEL_COLUMNS)
    ])))


def effective_mode(config: dict, mode: Mode = Mode.AUTO) -> Mode:
    if mode is Mode.TRAINING and "file_path" not in config:
        raise ValueError("training mode needs 'file_path'")
    if mode is Mode.LIVE and "df" not in config:
        raise ValueError("live mode needs 'df'")
    if mode is not Mode.AUTO:
        return mode
    if "df" in config:
        return Mode.LIVE
    if "file_path" in config:
        return Mode.TRAINING
    raise ValueError("give either 'df' or 'file_path'")


class Pipeline:
    """One entry for files and frames, batch or streaming. A wrong config fails on construction."""

    def __init__(self, spark: SparkSession, config: dict, mode: Mode = Mode.AUTO):
        self.spark, self.config = spark, dict(config)
        self.mode = effective_mode(self.config, mode)

    def run(self) -> DataFrame:
        if self.mode is Mode.LIVE:
            return require_columns(self.config["df"])
        return read_history_csv(self.spark, self.config["file_path"],
                                schema=self.config.get("schema", FLAT_VBP_TEXT))

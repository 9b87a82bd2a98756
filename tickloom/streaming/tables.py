"""State of streams as tables in the shared folder: no rows per key in a state store, and none in Python.

Every micro-batch is a batch job. It reads what earlier batches left, does its work with the batch operators, and writes its result and
what it leaves to folders of its own number. A batch that is repeated after a crash reads the same state and replaces the same folders, so
nothing is lost or written twice. Keys that hold most of the rows are split as in the batch operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.columns import named, quoted
from tickloom.operators.lookback import LOOKBACK, entry_struct
from tickloom.operators.sequence import framed, join_alike, last_n_per_key, running
from tickloom.schemas import BAR_KEY, SYMBOL, TIME
from tickloom.session import checkpoint_location, staged
from tickloom.sources.folders import matching, remove

#: Partition column of a batch's results; history comes as batch -1.
BATCH = "__batch"
#: Parts of a day's seen rows, and runs of one size that are merged into one.
BUCKETS, MERGED_RUNS = 16, 8


# -- lookback ----------------------------------------------------------------------------------

def _versions(spark: SparkSession, state: str) -> dict[int, str]:
    """Finished versions of a state table by number."""
    return {int(p.split("version=")[1].split("/")[0]): p.rsplit("/", 1)[0] for p in matching(spark, f"{state}/version=*/_SUCCESS")}


def heads(placed: DataFrame, n: int) -> DataFrame:
    """The newest n bars per symbol of (symbol, time, entry, index) rows, as the next batch needs them.

    `step` adds up to positions: the oldest bar kept counts for all before it.
    """
    newest = last_n_per_key(placed.select(*BAR_KEY, "__entry", "index"), [SYMBOL], TIME, n)
    oldest = newest.groupBy(SYMBOL).agg(F.min("index").alias("__least"))
    return join_alike(newest, oldest, [SYMBOL]).select(
        *BAR_KEY, "__entry", F.when(F.col("index") == F.col("__least"), F.col("index") + 1).otherwise(F.lit(1)).cast("bigint").alias("step"))


def place(bars: DataFrame, state: DataFrame | None, columns: Sequence[str] | None) -> DataFrame:
    """The state's rows and a batch's bars with `index`; late bars are marked and have none.

    A bar that the state holds already is dropped, and of copies in the batch one stays. Any other that is not newer than
    its symbol's newest, or has no time, is late.
    """
    body = F.struct(*[named(c) for c in bars.columns if c not in BAR_KEY])
    untimed = F.when(F.col(TIME).isNull(), F.monotonically_increasing_id())  # bars without a time are no copies of each other
    rows = bars.withColumn("__own", untimed).dropDuplicates([*BAR_KEY, "__own"]).select(
        *BAR_KEY, entry_struct(bars, columns).alias("__entry"), F.lit(1).cast("bigint").alias("step"), body.alias("__row"))
    if state is None:
        marked = rows.withColumn("__late", F.col(TIME).isNull())
        known = rows.limit(0).drop("__row")
    else:
        known = state
        last = state.groupBy(SYMBOL).agg(F.max(TIME).alias("__last"))
        new = join_alike(rows, state.select(*BAR_KEY), BAR_KEY, "left_anti")
        marked = join_alike(new, last, [SYMBOL], "left").withColumn(
            "__late", F.col(TIME).isNull() | F.coalesce(F.col(TIME) <= F.col("__last"), F.lit(False))).drop("__last")
    kind = rows.schema["__row"].dataType
    sequence = known.select("*", F.lit(None).cast(kind).alias("__row"), F.lit(False).alias("__late")).unionByName(
        marked.filter(~F.col("__late")))
    counted = running(sequence, [SYMBOL], TIME, {"index": F.col("step")}).withColumn("index", F.col("index") - 1)
    return counted.unionByName(marked.filter("__late").withColumn("index", F.lit(None).cast("bigint"))).drop("step")


def looked_back(placed: DataFrame, n: int) -> DataFrame:
    """The batch's own bars with index, lookback and late, state rows gone."""
    on_time = placed.filter(~F.col("__late"))
    looked = framed(on_time, [SYMBOL], TIME, n, position="index", columns=lambda w: {
        "lookback": F.reverse(F.collect_list("__entry").over(w.rowsBetween(-n, -1)))}).filter(F.col("__row").isNotNull())
    late = placed.filter("__late").withColumn("lookback", F.lit(None).cast(looked.schema["lookback"].dataType))
    return looked.unionByName(late).select(*BAR_KEY, "__row.*", "index", "lookback", F.col("__late").alias("late"))


def run_lookback(bars: DataFrame, write: Callable[[DataFrame, int], None], state: str, n: int = LOOKBACK,
                 columns: Sequence[str] | None = None, history: DataFrame | None = None, label: str | None = None,
                 available_now: bool = False, keep_late: bool = False) -> StreamingQuery:
    """Bars of a stream with index and lookback, handed to `write(rows, batch)`; `history` first, as batch -1.

    History and updates are one call: what history holds is written with its own lookback once, and the updates
    go on from its last n bars. State is a table per batch, the last n bars per symbol; a version is read by one batch
    and removed when a later one is done.
    """
    spark = bars.sparkSession
    if history is not None and not _versions(spark, state):
        with staged(place(history, None, columns), "history") as placed:
            rows = looked_back(placed, n)
            write(rows if keep_late else rows.filter(~F.col("late")).drop("late"), -1)
            heads(placed.filter(~F.col("__late")), n).write.mode("overwrite").parquet(f"{state}/version=0")

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [v for v in _versions(spark, state) if v <= batch_id]
        before = spark.read.parquet(_versions(spark, state)[max(known)]) if known else None
        with staged(place(batch, before, columns), "placed") as placed:
            rows = looked_back(placed, n)
            write(rows if keep_late else rows.filter(~F.col("late")).drop("late"), batch_id)
            heads(placed.filter(~F.col("__late")), n).write.mode("overwrite").parquet(f"{state}/version={batch_id + 1}")
        for version, path in _versions(spark, state).items():
            if version < batch_id:
                remove(spark, path)

    writer = bars.writeStream.option("checkpointLocation", checkpoint_location(spark, label)).foreachBatch(advance)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def state_folder(spark: SparkSession, label: str | None, kind: str) -> str:
    """Where a stream of this name keeps its tables."""
    return f"{checkpoint_location(spark, label)}-{kind}"


# -- rows seen before --------------------------------------------------------------------------

def _hashes(columns: Sequence[str]) -> dict[str, Column]:
    """128 bits of the columns' values, NULLs told apart by their place."""
    values = [named(c) for c in columns]
    empty = [v.isNull() for v in values]
    return {"__h1": F.xxhash64(*values, *empty), "__h2": F.xxhash64(F.lit("second"), *empty, *values)}


def _runs(spark: SparkSession, seen: str) -> list[tuple[int, int, str]]:
    """(last batch, size class, folder) of every run of seen rows."""
    found = []
    for path in matching(spark, f"{seen}/run=*"):
        last, size = re.search(r"run=(\d+)-(\d+)$", path.rstrip("/")).groups()
        found.append((int(last), int(size), path))
    return sorted(found)


_SEEN = "__h1 bigint, __h2 bigint, __day string, __bucket int"


def _seen(spark: SparkSession, runs: Sequence[str], days: Sequence[str]) -> DataFrame:
    """Hashes of the runs; with `days`, only those folders are listed and read."""
    parts = [p for run in runs for day in days for p in matching(spark, f"{run}/__day={day}")] if days else list(runs)
    frames = [spark.read.schema(_SEEN).option("basePath", run).parquet(*own) for run in runs
              if (own := [p for p in parts if p.startswith(run)])]
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], _SEEN)


def _write_run(hashes: DataFrame, folder: str) -> None:
    hashes.select("__h1", "__h2", "__day", "__bucket").write.mode("overwrite").partitionBy("__day", "__bucket").parquet(folder)


def _merge_runs(spark: SparkSession, seen: str, batch_id: int) -> None:
    """Runs of one size become one of the next size; the old ones go after that, so a crash leaves rows twice, never missing."""
    runs = [r for r in _runs(spark, seen) if r[0] < batch_id]
    for size in sorted({r[1] for r in runs}):
        same = [r for r in runs if r[1] == size]
        if len(same) >= MERGED_RUNS:
            merged = _seen(spark, [r[2] for r in same], []).distinct()
            _write_run(merged.repartition("__day", "__bucket"), f"{seen}/run={same[-1][0]:012d}-{size + 1}")
            for _, _, folder in same:
                remove(spark, folder)


def run_unseen(stream: DataFrame, path: str, seen: str, values: Sequence[str] | None = None, time: str = TIME,
               include_time: bool = True, label: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Append every row whose values have not arrived before, however late it comes; there is no watermark and nothing is dropped.

    What has arrived is kept as hashes in files by day and bucket. A batch reads the days and buckets that its
    own rows fall into, whatever the length of the history; files that pile up are merged size by size. Rows without a time have a
    folder of their own. Without the time in the comparison every day can hold a row's twin: all hashes then lie under one day.
    """
    keys = [c for c in (values or stream.columns) if c != time] + ([time] if include_time else [])

    def advance(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.date_format(named(time), "yyyy-MM-dd"), F.lit("none")) if include_time else F.lit("all")
        hashed = batch.withColumns({**_hashes(keys), "__day": day})
        hashed = hashed.withColumn("__bucket", F.pmod("__h1", F.lit(BUCKETS)).cast("int"))
        with staged(hashed.dropDuplicates(["__day", "__h1", "__h2"]), "arrived") as arrived:
            cells = arrived.groupBy("__day").agg(F.collect_set("__bucket").alias("b")).collect()  # at most BUCKETS numbers a day
            known = _seen(spark, [r[2] for r in _runs(spark, seen) if r[0] < batch_id], [r["__day"] for r in cells])
            known = known.filter(F.col("__bucket").isin(sorted({b for r in cells for b in r["b"]})))
            fresh = arrived.join(known, ["__day", "__bucket", "__h1", "__h2"], "left_anti")
            with staged(fresh, "fresh") as new:
                new.select(*[quoted(c) for c in batch.columns]).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
                _write_run(new, f"{seen}/run={batch_id:012d}-0")
        _merge_runs(spark, seen, batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint_location(stream.sparkSession, label)).foreachBatch(advance)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that the batches of a stream wrote below `path`."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(path).drop(BATCH)

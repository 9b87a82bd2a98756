"""The live pipeline as Structured Streaming queries.

Stateless steps (`reshape.flatten`, `reshape.clean`, filters) are the batch functions. Event times
are TIMESTAMP while streaming, because watermarks need them (keep the session in UTC), and
TIMESTAMP_NTZ again at the sinks. A checkpoint folder with a stable name makes a query resume
where it stopped.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.columns import named
from tickloom.operators import bars as B
from tickloom.operators.reshape import clean, flatten, to_flat
from tickloom.operators.sequence import latest_per_key
from tickloom.schemas import BAR_KEY, HELPER_COLUMNS, RAW_BAR, SYMBOL, TIME
from tickloom.session import checkpoint_location
from tickloom.sources.folders import matching, remove
from tickloom.sources.tape import TAPE_ORDER
from tickloom.streaming.lookback import stream_lookback
from tickloom.streaming.tables import BATCH, run_lookback, state_folder

log = logging.getLogger(__name__)

LATENESS = "30 minutes"
#: Partition column of the versions that update_files writes.
VERSION = BATCH
#: Partition column of the folders that route writes.
ROUTE = "__route"


def read_bar_stream(spark: SparkSession, path: str, schema: T.StructType = RAW_BAR, fmt: str = "parquet",
                    files_per_batch: int | None = None) -> DataFrame:
    """Nested bars arriving as files; `files_per_batch` bounds the first batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def of_subscription(stream: DataFrame, request_id: int | str, column: str = "subscription_id") -> DataFrame:
    """Only the responses of one subscription of a multiplexed stream."""
    return stream.filter(F.col(column) == request_id).drop(column)


def event_time(stream: DataFrame, lateness: str = LATENESS, time: str = TIME) -> DataFrame:
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def plain_time(df: DataFrame) -> DataFrame:
    """TIMESTAMP columns back to TIMESTAMP_NTZ, for sinks."""
    return df.withColumns({f.name: named(f.name).cast("timestamp_ntz") for f in df.schema.fields
                           if isinstance(f.dataType, T.TimestampType)})


def bars_from_trades(trades: DataFrame, width: str = B.DEFAULT_WIDTH, lateness: str = LATENESS,
                     order: Sequence[str] = TAPE_ORDER) -> DataFrame:
    """Bars of a trade stream. Append mode emits a bar once, when the watermark closes it;
    update mode emits every change of an open bar. Trades behind the watermark are dropped and
    counted in the query's metrics."""
    return B.ohlcv(event_time(trades, lateness, "ts"), width, order)


def drop_seen(stream: DataFrame, lateness: str = LATENESS, values: Sequence[str] | None = None,
              time: str = TIME) -> DataFrame:
    """First arrival of every row; state is kept as long as a copy may still arrive in time."""
    keys = list(values or stream.columns)
    return event_time(stream, lateness, time).dropDuplicatesWithinWatermark(
        keys if time in keys else [*keys, time])


def live_levels(bars: DataFrame, n: int = 10, columns: Sequence[str] | None = None, on_bar_close: bool = True,
                lateness: str = LATENESS, keep_late: bool = False) -> DataFrame:
    """Raw bar stream to flat level rows with their lookback.

    With `on_bar_close` only closed bars pass, each once; they alone feed the lookback. Without
    it every update of a bar passes, flat and cleaned, and carries no lookback. `keep_late` keeps
    bars that come too late for a lookback, marked in the column `late`.
    """
    if not on_bar_close:
        return plain_time(to_flat(bars))
    closed = B.closed_bars(bars) if HELPER_COLUMNS[0] in bars.columns else bars
    once = event_time(closed, lateness).dropDuplicatesWithinWatermark(BAR_KEY)
    looked = stream_lookback(clean(once), n, columns, keep_late)
    return plain_time(flatten(looked))


# -- sinks -----------------------------------------------------------------------------------

def _writer(stream: DataFrame, label: str | None, available_now: bool, mode: str):
    writer = stream.writeStream.outputMode(mode).option(
        "checkpointLocation", checkpoint_location(stream.sparkSession, label))
    return writer.trigger(availableNow=True) if available_now else writer


def without_nested(df: DataFrame) -> DataFrame:
    return df.select(*[named(f.name) for f in df.schema.fields
                       if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))])


def append_files(stream: DataFrame, path: str, fmt: str = "parquet", label: str | None = None,
                 available_now: bool = False) -> StreamingQuery:
    """Exactly-once append. CSV gets the plain columns only; nested ones (the lookback) stay out."""
    out = without_nested(stream) if fmt == "csv" else stream
    writer = _writer(out, label, available_now, "append").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    return writer.start(path)


def update_files(stream: DataFrame, path: str, label: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Every change of an open row, one folder per micro-batch; a batch that is repeated replaces its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{VERSION}={batch_id}")

    return deliver(stream, write, label, available_now, "update")


def newest(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The last version of each row that `update_files` wrote, rows that are still open included."""
    versions = spark.read.schema(T.StructType([*schema.fields, T.StructField(VERSION, T.LongType())])).parquet(path)
    rest = [c for c in schema.names if c not in keys]
    return versions.groupBy(*[named(k) for k in keys]).agg(*[F.max_by(named(c), VERSION).alias(c) for c in rest])


def deliver(stream: DataFrame, callback: Callable[[DataFrame, int], None], label: str | None = None,
            available_now: bool = False, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to a function. An error fails the batch, which is then retried on restart."""
    def run(batch: DataFrame, batch_id: int) -> None:
        callback(batch, batch_id)

    return _writer(stream, label, available_now, mode).foreachBatch(run).start()


#: Folders of rows whose subscription has no handler, and of rows without one.
UNKNOWN, NO_ID = "unknown", "none"


def route(stream: DataFrame, handlers: Mapping[int | str, Callable[[DataFrame], None]],
          column: str = "subscription_id", label: str | None = None, available_now: bool = False,
          path: str | None = None) -> StreamingQuery:
    """Give each subscription's rows to its handler.

    A batch is read once and written once, into a folder per subscription; Spark's commit of that write is the mark that all of them are
    complete, and a handler reads its own folder only. Rows of unknown subscriptions and rows without one have folders of
    their own and are reported. With `path` the folders stay, for `routed`; otherwise a batch's go when its handlers are done.
    """
    spark = stream.sparkSession
    root = path or state_folder(spark, label, "routed")
    known = {str(k): k for k in handlers}

    def run(batch: DataFrame, batch_id: int) -> None:
        own = F.col(column).cast("string")
        folder = F.when(own.isNull(), NO_ID).when(own.isin(list(known)), F.concat(F.lit("id-"), own)).otherwise(UNKNOWN)
        target = f"{root}/{BATCH}={batch_id}"
        batch.withColumn(ROUTE, folder).write.mode("overwrite").partitionBy(ROUTE).parquet(target)
        session = batch.sparkSession
        for folder_name, handler in [(f"id-{k}", handlers[known[k]]) for k in known]:
            if own_rows := matching(session, f"{target}/{ROUTE}={folder_name}"):
                handler(session.read.schema(batch.schema).parquet(*own_rows).drop(column))
        for name in (UNKNOWN, NO_ID):
            if others := matching(session, f"{target}/{ROUTE}={name}"):
                log.warning("batch %d: %d rows without a handler (%s)", batch_id, session.read.schema(batch.schema).parquet(*others).count(), name)
        if path is None:
            remove(session, target)

    return _writer(stream, label, available_now, "append").foreachBatch(run).start()


def routed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that `route` wrote below `path`, with the folder they went to; a filter on that reads the folder alone."""
    extra = [T.StructField(BATCH, T.LongType()), T.StructField(ROUTE, T.StringType())]
    return spark.read.schema(T.StructType([*schema.fields, *extra])).parquet(path).drop(BATCH)


def monitor(bars: DataFrame, show: Callable[[DataFrame, int], None], label: str | None = None,
            available_now: bool = False) -> StreamingQuery:
    """Raw monitor: per batch, the level rows of each symbol's latest bar."""
    def latest(batch: DataFrame, batch_id: int) -> None:
        show(latest_per_key(batch, [SYMBOL], TIME), batch_id)

    return deliver(plain_time(to_flat(bars)), latest, label, available_now)


def run_live(bars: DataFrame, path: str, n: int = 10, columns: Sequence[str] | None = None, fmt: str = "parquet",
             label: str | None = None, available_now: bool = False, keep_late: bool = False,
             history: DataFrame | None = None) -> StreamingQuery:
    """The live loop: closed bars, each once, flat, with lookback, written to files batch by batch.

    `history` (bars of the same columns) is written first and feeds the lookback of the updates: initial history and live updates
    are one call. State is the last n bars per symbol in a table (see `tables`), so late bars need no watermark: with
    `keep_late` they are written too, marked in the column `late`. Stop with `query.stop()`; with the same label it goes on.
    """
    spark = bars.sparkSession

    def closed(rows: DataFrame) -> DataFrame:
        return clean(B.closed_bars(rows) if HELPER_COLUMNS[0] in rows.columns else rows)

    def write(rows: DataFrame, batch_id: int) -> None:
        out = flatten(rows)
        target = f"{path}/{VERSION}={batch_id}"
        if fmt == "csv":
            without_nested(out).write.mode("overwrite").option("header", True).csv(target)
        else:
            out.write.mode("overwrite").format(fmt).save(target)

    label = label or uuid.uuid4().hex
    return run_lookback(closed(bars), write, state_folder(spark, label, "state"), n, columns,
                        None if history is None else closed(history), label, available_now, keep_late)

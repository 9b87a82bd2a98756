"""Streaming queries, run to the end of the given tables and read back from their sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.lookback import level_lookback
from tickloom.operators.reshape import flatten, from_date
from tickloom.plans import inputs as I
from tickloom.plans.base_sql import BARS, TAPE, with_ctes
from tickloom.plans.market import LOOKBACK_SQL
from tickloom.plans.registry import query, result
from tickloom.schemas import BAR_KEY, TIME
from tickloom.session import checkpoint_location, write_stage
from tickloom.sources.tape import table, tape_from_events
from tickloom.streaming import live
from tickloom.streaming.lookback import bootstrap, stream_lookback
from tickloom.streaming.tables import read_batches, run_unseen


def _to_end(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there, into files, and read those."""
    spark = stream.sparkSession
    path = checkpoint_location(spark)
    live.append_files(stream, path, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")


@query("stream_bars", with_ctes(TAPE, BARS) + """
SELECT symbol, DateTime, open, high, low, close, volume, delta FROM bars""")
def stream_bars(spark, sf):
    """Every change of a bar is written; the last version of each is the bar, the open ones at the end included."""
    made = live.plain_time(live.bars_from_trades(tape_from_events(_events_stream(spark, sf))))
    path = checkpoint_location(spark)
    live.update_files(made, path, available_now=True).awaitTermination()
    return result(live.newest(spark, path, made.schema, BAR_KEY), *BAR_KEY, "Open", "High", "Low", "Close", "Volume", "Delta")


@query("stream_lookback", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, h.bar_index - p.bar_index AS i, p.DateTime AS t_ts, p.head_price AS t_price,
       p.close AS t_close
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime
JOIN heads p ON p.symbol = h.symbol AND p.bar_index BETWEEN h.bar_index - 10 AND h.bar_index - 1""")
def stream_lookback_rows(spark, sf):
    """History is batch; the bars after it are streamed on top of the last ten per symbol. All bars' rows."""
    bars = I.nested(spark, sf)
    cutoff = F.lit("2024-01-25").cast("timestamp_ntz")
    history = bars.filter(F.col(TIME) < cutoff)
    later = from_date(bars, "2024-01-25").withColumn("index", F.lit(None).cast("bigint"))
    arriving = bootstrap(history, 10).unionByName(later)
    stream = live.read_bar_stream(spark, write_stage(arriving, "arriving"), arriving.schema)
    streamed = _to_end(flatten(stream_lookback(stream, 10, ["Price", "Close"])).filter(F.col(TIME) >= cutoff))
    rows = level_lookback(history, 10, ["Price", "Close"]).unionByName(streamed)
    long = rows.select(*BAR_KEY, "Price", F.posexplode("lookback").alias("at", "t"))
    return result(long, *BAR_KEY, "Price", (F.col("at") + 1).cast("bigint").alias("i"),
                  F.col("t.timestamp").alias("t_ts"), F.col("t.Price").alias("t_price"),
                  F.col("t.Close").alias("t_close"))


@query("stream_dedup", """
SELECT DISTINCT event_id, ts, user_id % 4 AS lane, event_type
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)""")
def stream_dedup(spark, sf):
    """Every 50th event arrives twice."""
    events = _events_stream(spark, sf)
    copies = F.when(F.col("event_id") % 50 == 0, F.lit(2)).otherwise(F.lit(1))
    twice = events.select("event_id", "ts", (F.col("user_id") % 4).alias("lane"), "event_type",
                          F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")
    return _to_end(live.plain_time(live.drop_seen(twice, time="ts")))


@query("stream_live", LOOKBACK_SQL + """
SELECT l.symbol, l.DateTime, l.price, h.bar_index - p.bar_index AS i, p.DateTime AS t_ts, p.head_price AS t_price,
       p.close AS t_close
FROM levels l JOIN heads h ON l.symbol = h.symbol AND l.DateTime = h.DateTime
JOIN heads p ON p.symbol = h.symbol AND p.bar_index BETWEEN h.bar_index - 10 AND h.bar_index - 1""")
def stream_live(spark, sf):
    """History and three rounds of updates through the live loop, which stops and goes on between them."""
    bars = I.nested(spark, sf)
    cuts = [F.lit(f"2024-01-{day}").cast("timestamp_ntz") for day in ("10", "17", "24")]
    arriving, out, label = checkpoint_location(spark), checkpoint_location(spark), f"live-{uuid.uuid4().hex}"
    for first, end in zip(cuts, [*cuts[1:], None]):
        part = bars.filter(F.col(TIME) >= first)
        (part if end is None else part.filter(F.col(TIME) < end)).write.mode("append").parquet(arriving)
        stream = live.read_bar_stream(spark, arriving, bars.schema)
        live.run_live(stream, out, 10, ["Price", "Close"], label=label, available_now=True,
                      history=bars.filter(F.col(TIME) < cuts[0])).awaitTermination()
    rows = spark.read.parquet(out)
    long = rows.select(*BAR_KEY, "Price", F.posexplode("lookback").alias("at", "t"))
    return result(long, *BAR_KEY, "Price", (F.col("at") + 1).cast("bigint").alias("i"),
                  F.col("t.timestamp").alias("t_ts"), F.col("t.Price").alias("t_price"),
                  F.col("t.Close").alias("t_close"))


@query("stream_dedup_late", """
SELECT DISTINCT event_id, ts, user_id % 4 AS lane, event_type
FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)""")
def stream_dedup_late(spark, sf):
    """Every 50th event arrives twice, and every 7th only two batches after its time: no watermark lets it go."""
    events = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("lane"), "event_type")
    late = F.col("event_id") % 7 == 0
    copies = events.filter(F.col("event_id") % 50 == 0)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    rounds = [events.filter(early & ~late), events.filter(~early & ~late).unionByName(copies),
              events.filter(late).unionByName(copies)]
    arriving, out, seen, label = (checkpoint_location(spark) for _ in range(4))
    for part in rounds:
        part.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).parquet(arriving)
        run_unseen(stream, out, seen, time="ts", label=label.rsplit("/", 1)[1], available_now=True).awaitTermination()
    return read_batches(spark, out, events.schema)


@query("stream_route", """
SELECT event_id, CASE WHEN user_id % 5 = 4 THEN 'none' WHEN user_id % 5 = 3 THEN 'unknown' ELSE 'id-' || (user_id % 5) END AS folder,
       CASE WHEN user_id % 5 < 3 THEN 1 ELSE 0 END AS handled
FROM events""")
def stream_route(spark, sf):
    """Three subscriptions with handlers, one without, and rows of none; handlers keep what they got."""
    events = _events_stream(spark, sf)
    stream = events.select("event_id", F.when(F.col("user_id") % 5 < 4, F.col("user_id") % 5).alias("subscription_id"))
    out, kept = checkpoint_location(spark), checkpoint_location(spark)
    handlers = {i: (lambda df: df.write.mode("append").parquet(kept)) for i in range(3)}
    live.route(stream, handlers, available_now=True, path=out).awaitTermination()
    handled = spark.read.parquet(kept).select("event_id", F.lit(1).alias("handled"))
    return live.routed(spark, out, stream.schema).join(handled, "event_id", "left").select(
        "event_id", F.col(live.ROUTE).alias("folder"), F.coalesce("handled", F.lit(0)).alias("handled"))

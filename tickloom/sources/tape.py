"""Trade tapes (symbol, ts, trade_id, price, size, side) from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Orders trades that share a timestamp, so that first and last trade are well defined.
TAPE_ORDER = ["ts", "trade_id"]
DAILY_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "size"]


def to_tick(value, tick: float):
    return F.floor(value / tick + F.lit(0.5)) * F.lit(float(tick))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"),
        "ts",
        F.col("event_id").alias("trade_id"),
        to_tick(F.col("value"), 5).alias("price"),
        (F.get_json_object("props", "$.k").cast("bigint") + 1).alias("size"),
        F.when(F.col("event_type").isin("click", "view"), "bid").otherwise("ask").alias("side"),
    )


def tape_from_lineitem(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.concat(F.lit("P"), F.col("l_suppkey") % 4).alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        to_tick(F.col("l_extendedprice") / F.col("l_quantity"), 1000).alias("price"),
        F.col("l_quantity").cast("bigint").alias("size"),
        F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape_from_events(table(spark, sf_dir, "events"))


def tape_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape_from_lineitem(table(spark, sf_dir, "lineitem"))

"""The tables the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.schemas import TIME
from tickloom.sources.tape import table, tape, tape_daily


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return B.ohlcv(tape(spark, sf))


def levels(spark: SparkSession, sf: str) -> DataFrame:
    return B.profile(tape(spark, sf))


def nested(spark: SparkSession, sf: str) -> DataFrame:
    return B.nested_bars(tape(spark, sf))


def daily_levels(spark: SparkSession, sf: str) -> DataFrame:
    return B.profile(tape_daily(spark, sf), "1 day")


def slot():
    """Number of the quarter hour inside the month; faults are planted by it."""
    return F.dayofmonth(TIME) * 96 + F.hour(TIME) * 4 + F.floor(F.minute(TIME) / 15)


def dirty_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with contradicting prices, negative volumes and NULLs, and without RVOL and Price."""
    s = slot()
    return bars(spark, sf).select(
        "symbol", TIME, "Open",
        F.when(s % 11 == 0, F.col("Low") - 5).otherwise(F.col("High")).alias("High"), "Low",
        F.when(s % 17 != 0, F.col("Close")).alias("Close"),
        F.when(s % 13 == 0, -F.col("Volume")).otherwise(F.col("Volume")).alias("Volume"),
        F.when(s % 19 != 0, F.col("Delta")).alias("Delta"),
    )


def dirty_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with planted NULLs; every 50th row also occurs twice, as an exact copy."""
    events = table(spark, sf, "events")
    holed = events.select(
        "event_id", "ts",
        F.when(F.col("event_id") % 31 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 43 != 0, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"), "props",
    )
    copies = F.when(F.col("event_id") % 50 == 0, F.lit(2)).otherwise(F.lit(1))
    return holed.select("*", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).drop("copy")


DIRTY_EVENTS_SQL = """
dirty_events AS (
  SELECT event_id, ts, CASE WHEN event_id % 31 <> 0 THEN user_id END AS user_id,
         CASE WHEN event_id % 43 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 97 <> 0 THEN value END AS value, props
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0)
)"""

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]

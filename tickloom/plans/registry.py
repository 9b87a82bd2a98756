"""Named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return register


# Result column names of the queries.
RESULT_NAMES = {
    "Price": "price", "BidVol": "bid_vol", "AskVol": "ask_vol", "TotalVolume": "total_volume",
    "NumOfTrades": "num_trades", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Volume": "volume", "Trades": "trades", "Delta": "delta", "CumulativeDelta": "cumulative_delta",
    "TodayOpen": "today_open", "TodayHigh": "today_high", "TodayLow": "today_low", "RVOL": "rvol",
    "LTMaxVol": "lt_max_vol", "LTTotalVol": "lt_total_vol", "LargeBidTrade": "large_bid",
    "LargeAskTrade": "large_ask", "NumLevels": "n_levels", "PocPrice": "poc_price", "VaLow": "va_low",
    "VaHigh": "va_high", "VaVolume": "va_volume", "Share": "share", "CloseChange": "close_change",
    "SessionDelta": "value",
}


def result(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Chosen columns under their result names."""
    return df.select(*[
        F.col(c).alias(RESULT_NAMES[c]) if isinstance(c, str) and c in RESULT_NAMES else c for c in columns
    ])


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def significant(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Floating sums differ in their last bits between engines: keep the leading digits."""
    return df.withColumns({
        c: F.format_string(f"%.{digits}e", F.col(c)).cast("double") for c in columns
    })

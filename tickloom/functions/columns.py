"""Column expressions and schema helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schemas import TIME

# Word lists that decide a column's role from its name.
ROLE_WORDS = {
    "date": ["date", "time", "timestamp", "datetime"],
    "price": ["price", "close", "open", "high", "low"],
    "volume": ["volume", "vol", "quantity", "size"],
    "time": ["time", "date", "timestamp", "datetime"],
}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """Reference a column whose name may hold dots."""
    return F.col(quoted(name))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value downstream, so counts agree everywhere."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floats else named(c)
        for c in df.columns
    ])


def bar_start(time: str | Column, width: str) -> Column:
    return F.window(time, width)["start"]


def side_volume(side: str, volume: str = "size") -> Column:
    return F.sum(F.when(F.col("side") == side, F.col(volume)).otherwise(F.lit(0)))


def columns_with_role(df: DataFrame, role: str) -> list[str]:
    words = ROLE_WORDS[role]
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def first_date_column(df: DataFrame) -> str | None:
    """First date-like column that is a time, or a text whose values, all of them, can be read as one."""
    native, texts = set(time_columns(df)), set(text_columns(df))
    likely = [c for c in columns_with_role(df, "date") if c in native | texts]
    asked = [c for c in likely if c in texts]
    counts = df.agg(*[F.struct(
        F.count(named(c)).alias("given"), F.count(F.expr(f"try_cast({quoted(c)} AS timestamp_ntz)")).alias("read"),
    ).alias(f"__{i}") for i, c in enumerate(asked)]).first() if asked and likely[0] not in native else []
    readable = {c for c, n in zip(asked, counts) if 0 < n["given"] == n["read"]}
    return next((c for c in likely if c in native or c in readable), None)


def _seconds_of_day(clock: str) -> int:
    hours, minutes, seconds = (int(x) for x in clock.split(":"))
    return hours * 3600 + minutes * 60 + seconds


def in_time_of_day(time: str, start: str, end: str) -> Column:
    """Time of day inside [start, end]; wraps past midnight when start is later than end."""
    second = F.expr(f"extract(SECOND FROM {quoted(time)})")
    clock = F.hour(time) * 3600 + F.minute(time) * 60 + second
    lo, hi = _seconds_of_day(start), _seconds_of_day(end)
    return clock.between(lo, hi) if lo <= hi else (clock >= lo) | (clock <= hi)


def time_text(time: str = TIME) -> Column:
    """yyyy-MM-dd HH:mm:ss, and six digits more for a time between two seconds, whatever the session's zone."""
    text = F.col(quoted(time)).cast("string")
    return F.when(F.length(text) > 19, F.rpad(text, 26, "0")).otherwise(text)


def micros_between(start: str, end: str) -> Column:
    """Microseconds from start to end."""
    steps = f"CAST({quoted(end)} - {quoted(start)} AS INTERVAL SECOND)"
    return (F.expr(f"CAST({steps} AS DECIMAL(18, 6))") * 1_000_000).cast("bigint")


def day(time: str = TIME) -> Column:
    return F.to_date(time)

"""N-bar lookback on a stream: per symbol, the state holds its last N bars and nothing else.

Lag windows do not exist on streams, so this is the one operator with a Python function. It sees
bars, never levels one by one, and a bar's profile passes through it untouched. The batch operator
`lookback.with_lookback` gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.columns import quoted
from tickloom.operators.lookback import LOOKBACK, bar_index, entry_struct
from tickloom.operators.sequence import last_n_per_key
from tickloom.schemas import SYMBOL, TIME

# last: microseconds of the newest bar; entries: the newest bars' entries as text, latest first
STATE = "seen bigint, last bigint, entries array<string>"

# Bars and entries travel through the Python function as text: every type stays what it was, times keep their microseconds
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _step(n: int):
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, entries = state.get if state.exists else (0, None, [])
        entries = list(entries)
        # One symbol's bars of one micro-batch, at most one per bar width
        batch = pd.concat(list(batches)).sort_values("__time", kind="stable")
        places, late, past = [], [], []
        for time, given, entry in zip(batch["__time"], batch["__index"], batch["__entry"]):
            behind = pd.isna(time) or last is not None and time <= last
            late.append(behind)
            if behind:
                places.append(None)
                past.append(None)
                continue
            if not pd.isna(given):
                seen = int(given)
            places.append(seen)
            past.append("[" + ",".join(entries) + "]")
            seen, last = seen + 1, int(time)
            entries = [entry, *entries][:n]
        state.update((seen, last, entries))
        yield pd.DataFrame({
            **{c: batch[c] for c in batch.columns if not c.startswith("__")},
            "index": pd.array(places, dtype="Int64"), "late": late, "__past": past,
        })

    return advance


def stream_lookback(bars: DataFrame, n: int = LOOKBACK, columns: Sequence[str] | None = None,
                    keep_late: bool = False) -> DataFrame:
    """Add `index` and `lookback` to a stream of bars; entries keep the columns' types.

    An optional input column `index` gives positions to continue from, as `bootstrap` does. A bar
    that is not newer than what its symbol has seen, or has no time, cannot have a lookback any more: it is
    left out, or kept with `late` set and no lookback, for a quarantine.
    """
    has_index = "index" in bars.columns
    body = [c for c in bars.columns if c not in (SYMBOL, "index")]
    entry = entry_struct(bars.drop("index"), columns)
    payload = F.struct(*[quoted(c) for c in body])
    packed = bars.select(
        SYMBOL, F.unix_micros(F.col(TIME).cast("timestamp")).alias("__time"),
        (F.col("index") if has_index else F.lit(None)).cast("string").alias("__index"),
        F.to_json(entry, JSON_TIMES).alias("__entry"),
        F.to_json(payload, JSON_TIMES).alias("row"),
    )
    out = T.StructType([
        T.StructField(SYMBOL, T.StringType()), T.StructField("row", T.StringType()),
        T.StructField("index", T.LongType()), T.StructField("late", T.BooleanType()),
        T.StructField("__past", T.StringType()),
    ])
    done = packed.groupBy(SYMBOL).applyInPandasWithState(
        _step(n), out, STATE, "append", GroupStateTimeout.NoTimeout)
    past_type = T.ArrayType(bars.drop("index").select(entry.alias("e")).schema["e"].dataType)
    body_type = bars.select(payload.alias("p")).schema["p"].dataType
    opened = done.select(
        SYMBOL, F.from_json("row", body_type, JSON_TIMES).alias("r"), "index", "late",
        F.from_json("__past", past_type, JSON_TIMES).alias("lookback"))
    rows = opened.select(SYMBOL, *[F.col(f"r.{quoted(c)}").alias(c) for c in body], "index", "lookback", "late")
    return rows if keep_late else rows.filter(~F.col("late")).drop("late")


def bootstrap(history: DataFrame, n: int = LOOKBACK) -> DataFrame:
    """The last n bars per symbol of a batch history, with their positions.

    Put them in front of a stream to go on from there; rows up to the history's end are already
    known and can be filtered out behind it.
    """
    return last_n_per_key(bar_index(history), [SYMBOL], TIME, n)

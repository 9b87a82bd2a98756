"""Ordered operators against plain Python, with one symbol holding most rows and tiny blocks."""

from collections import defaultdict

import pytest
from frames import at, bar_frame, random_bars
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import sequence as S


@pytest.fixture(scope="module")
def rows():
    return random_bars()


def by_symbol(rows):
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found[r[0]].append(r)
    return found


def test_running_sum_and_total(spark, rows):
    df = S.running(bar_frame(spark, rows), ["symbol"], "DateTime", {"cum": F.col("Delta")}, totals={"all": "cum"})
    got = {(r["symbol"], r["DateTime"]): (r["cum"], r["all"]) for r in df.collect()}
    want = {}
    for symbol, bars in by_symbol(rows).items():
        total = 0
        for b in bars:
            total += b[7]
            want[(symbol, b[1])] = total
        for b in bars:
            want[(symbol, b[1])] = (want[(symbol, b[1])], total)
    assert got == want


def test_positions(spark, rows):
    df = S.with_position(bar_frame(spark, rows), ["symbol"], "DateTime", "at", total="n")
    got = {(r["symbol"], r["DateTime"]): (r["at"], r["n"]) for r in df.collect()}
    want = {(s, b[1]): (i, len(bars)) for s, bars in by_symbol(rows).items() for i, b in enumerate(bars)}
    assert got == want


def test_missing_keys_and_times_stay(spark):
    """As in a plain window: a NULL symbol is one of its own, a NULL time comes first, NULL deltas add nothing."""
    rows = [("A", at(0), None), ("A", None, 5), ("A", at(100), 2), ("A", at(300), None), (None, at(1), None),
            (None, at(200), 4), (None, None, None), ("B", None, 3)]
    df = spark.createDataFrame(rows, "symbol string, DateTime timestamp_ntz, Delta bigint")
    got = S.running(df, ["symbol"], "DateTime", {"cum": F.col("Delta"), "at": F.lit(1)}, totals={"all": "cum"})
    plain = Window.partitionBy("symbol").orderBy("DateTime").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("Delta").over(plain), F.count(F.lit(1)).over(plain),
                     F.sum("Delta").over(Window.partitionBy("symbol")))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    before = S.lagged(df, ["symbol"], "DateTime", {"before": "DateTime"})
    lag = df.select("*", F.lag("DateTime").over(Window.partitionBy("symbol").orderBy("DateTime")))
    assert sorted(map(str, map(tuple, before.collect()))) == sorted(map(str, map(tuple, lag.collect())))
    assert S.latest_per_key(df, ["symbol"], "DateTime").count() == 3


@pytest.mark.parametrize("back,block", [(1, 4), (3, 4), (5, 64), (7, None)])
def test_framed_equals_plain_window(spark, rows, back, block):
    df = S.framed(bar_frame(spark, rows), ["symbol"], "DateTime", back, lambda w: {
        "past": F.collect_list("Close").over(w.rowsBetween(-back, -1)), "before": F.lag("Close", back).over(w),
    }, block=block)
    got = {(r["symbol"], r["DateTime"]): (list(r["past"]), r["before"]) for r in df.collect()}
    want = {}
    for symbol, bars in by_symbol(rows).items():
        closes = [b[5] for b in bars]
        for i, b in enumerate(bars):
            want[(symbol, b[1])] = (closes[max(0, i - back):i], closes[i - back] if i >= back else None)
    assert got == want


def test_no_block_holds_a_whole_symbol(spark, rows):
    """The window of a framed operator is partitioned by block, not by symbol alone."""
    df = S.lagged(bar_frame(spark, rows), ["symbol"], "DateTime", {"before": "Close"})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    assert windows and all("__block" in line for line in windows)


@pytest.mark.parametrize("start,length", [(0, 5), (200, 7), (428, 9), (5000, 3)])
def test_position_slice(spark, start, length):
    rows = [(i % 7, (i * 37) % 11 if i % 5 else None, i % 3) for i in range(430)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = S.position_slice(df, ["a", "b", "c"], start, length).collect()
    # Spark sorts NULL first.
    want = sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))[start:start + length]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_position_slice_with_one_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2900, 5).otherwise(F.col("id")).alias("a"), "id")
    assert [r["a"] for r in S.position_slice(df, ["a"], F.expr("n_rows div 2"), 4).collect()] == [5] * 4
    exact = S.position_slice(df, ["a", "id"], F.expr("n_rows div 2"), 4)
    assert sorted(r["id"] for r in exact.collect()) == [1500, 1501, 1502, 1503]


def test_smallest(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = S.smallest(df, "v", F.floor(F.col("v") / 50), 120).collect()
    assert sorted(r["v"] for r in got) == list(range(120))
    assert S.smallest(df, "v", F.floor(F.col("v") / 50), 5000).count() == 1000


def test_latest_and_last_n(spark, rows):
    bars = bar_frame(spark, rows)
    want = by_symbol(rows)
    latest = {(r["symbol"], r["DateTime"]) for r in S.latest_per_key(bars, ["symbol"], "DateTime").collect()}
    assert latest == {(s, b[-1][1]) for s, b in want.items()}
    last = {(r["symbol"], r["DateTime"]) for r in S.last_n_per_key(bars, ["symbol"], "DateTime", 3).collect()}
    assert last == {(s, x[1]) for s, b in want.items() for x in b[-3:]}

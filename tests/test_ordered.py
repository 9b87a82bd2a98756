"""As-of joins, runs, exponential means and developing profiles against plain loops, one symbol holding most of the bars."""

from datetime import timedelta

import pytest
from frames import at, bar, bar_frame, random_bars
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.operators.reshape import flatten
from tickloom.operators.sequence import asof_join, carried, islands

QUOTES = "symbol string, DateTime timestamp_ntz, v int"


def by_symbol(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {s: sorted(g, key=lambda r: r[1]) for s, g in groups.items()}


def test_carried_over_empty_chunks(spark):
    rows = [("a", at(i), v) for i, v in ((0, 1), (1, None), (200, None), (400, None), (401, 5), (900, None))]
    rows += [(None, at(3), None), (None, at(500), 7), (None, at(700), None), ("b", None, 4), ("b", at(1), None)]
    found = carried(spark.createDataFrame(rows, QUOTES), ["symbol"], ["DateTime"], {"last": "v"})
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted([
        ("a", at(0), 1, 1), ("a", at(1), None, 1), ("a", at(200), None, 1), ("a", at(400), None, 1), ("a", at(401), 5, 5),
        ("a", at(900), None, 5), (None, at(3), None, None), (None, at(500), 7, 7), (None, at(700), None, 7),
        ("b", None, 4, 4), ("b", at(1), None, 4)], key=str)


def test_asof_join(spark):
    left = spark.createDataFrame([("a", at(i), i) for i in range(0, 900, 7)] * 2 + [("b", at(1), 0), (None, at(9), 1), ("a", None, 5)], QUOTES)
    quotes = [("a", at(i), i) for i in range(3, 400, 13)] + [("a", at(14), 1), ("a", at(14), 99), ("a", None, 1), (None, at(9), 3), ("c", at(0), 0)]
    right = spark.createDataFrame(quotes, QUOTES).withColumnRenamed("DateTime", "quoted")
    found = asof_join(left, {"q": (right, "quoted"), "late": (right.filter("v > 300"), "quoted")}, ["symbol"], "DateTime")

    def last(symbol, time, least=-1):
        known = [(t, v) for s, t, v in quotes if s == symbol and t is not None and v > least and time is not None and t <= time]
        return max(known, default=None)

    assert found.count() == left.count()
    for r in found.collect():
        for name, least in (("q", -1), ("late", 300)):
            assert (tuple(r[name]) if r[name] else None) == last(r["symbol"], r["DateTime"], least)


def test_time_frames_with_a_hot_symbol(spark):
    """Nine tenths of the bars are one symbol's; no task gets more than a day of it."""
    rows = random_bars(900, 90)
    found = B.multi_timeframe(bar_frame(spark, rows).drop("VolumeByPrice"))
    assert found.count() == len(rows)
    groups = by_symbol(rows)
    for r in found.collect():
        for name, width in (("Hour", timedelta(hours=1)), ("Day", timedelta(days=1))):
            start = {"Hour": lambda t: t.replace(minute=0), "Day": lambda t: t.replace(minute=0, hour=0)}[name]
            closed = [x for x in groups[r["symbol"]] if start(x[1]) + width <= r["DateTime"]]
            members = [x for x in closed if start(x[1]) == start(closed[-1][1])] if closed else []
            expected = (start(members[0][1]), members[0][2], max(x[3] for x in members), min(x[4] for x in members), members[-1][5],
                        sum(x[6] for x in members), sum(x[7] for x in members)) if members else (None,) * 7
            assert tuple(r[name + c] for c in ("Start", "Open", "High", "Low", "Close", "Volume", "Delta")) == expected


def test_no_window_over_a_symbol(spark):
    """Windows partitioned by the symbol alone see one row per chunk only."""
    plan = B.multi_timeframe(bar_frame(spark, random_bars(50, 5)).drop("VolumeByPrice"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("rowframe, unboundedpreceding$(), -1" in w.lower() or ", -1)" in w for w in windows) == 1


def runs_of(states):
    out, run, place, current = [], -1, 0, None
    for s in states:
        if s is not None and s != current:
            run, place, current = run + 1, 0, s
        out.append((None, None, None) if current is None else (current, run, place))
        place += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_islands(spark, seed):
    rows = random_bars(500, 40, seed)
    state = F.when(F.col("Delta") > 20, 1).when(F.col("Delta") < 5, 0)
    found = islands(bar_frame(spark, rows).drop("VolumeByPrice"), ["symbol"], "DateTime", state).collect()
    expected = {}
    for symbol, group in by_symbol(rows).items():
        states = [1 if r[7] > 20 else 0 if r[7] < 5 else None for r in group]
        expected.update({(symbol, r[1]): x for r, x in zip(group, runs_of(states))})
    assert {(r["symbol"], r["DateTime"]): (r["state"], r["run"], r["place"]) for r in found} == expected


def test_alerts(spark):
    deltas = [5, 0, 3, -1, -2, None, -4, 8, -1, 2, 2, 2]
    df = bar_frame(spark, [bar("a", 40 * i, delta=d) for i, d in enumerate(deltas)])
    assert sorted(tuple(r)[1:] for r in X.delta_trend_reversal(df, 3).collect()) == [
        (at(120), "down", 3, 8), (at(280), "up", 4, -7)]
    large = [(9, 1), (0, 0), (9, 1), (9, 1), (1, 9), (5, 5), (1, 9), (1, 9), (0, 0), (0, 0)]
    made = df.limit(0).select("symbol", "DateTime", F.lit(0).alias("LargeAskTrade"), F.lit(0).alias("LargeBidTrade"))
    made = spark.createDataFrame([("a", at(50 * i), a, b) for i, (a, b) in enumerate(large)], made.schema)
    assert sorted(tuple(r)[1:] for r in X.large_trade_alert(made, 1.5, 3).collect()) == [
        (at(100), "accumulation"), (at(400), "distribution")]


def means(deltas, span):
    decay, top, below, out = 1 - 2 / (span + 1), 0.0, 0.0, []
    for d in deltas:
        top, below = top * decay + (d or 0), below * decay + (d is not None)
        out.append(top / below if below else None)
    return out


@pytest.mark.parametrize("span", [3, 10, 500])
def test_ema(spark, span):
    deltas = [10, None, None, 20, *[(i * 37) % 101 - 50 if i % 9 else None for i in range(2500)]]
    df = bar_frame(spark, [bar("a", i, delta=d) for i, d in enumerate(deltas)] + [bar("b", 0, delta=None), bar("b", 1, delta=4)])
    found = {(r["symbol"], r["DateTime"]): r["value"] for r in X.delta_ema(df, span).collect()}
    for i, expected in enumerate(means(deltas, span)):
        assert found["a", at(i)] == pytest.approx(expected, rel=1e-9, abs=1e-9)
    assert found["b", at(0)] is None and found["b", at(1)] == 4


def test_ema_after_a_gap_of_blocks(spark):
    """Longer than two blocks without a delta: the mean stays, and the next delta all but replaces it."""
    df = bar_frame(spark, [bar("a", i, delta=7 if i == 0 else -3 if i == 1200 else None) for i in range(1202)])
    found = {r["DateTime"]: r["value"] for r in X.delta_ema(df, 2).collect()}
    assert [found[at(i)] for i in (0, 500, 1199, 1200, 1201)] == pytest.approx([7, 7, 7, -3, -3])
    assert [r["value"] for r in X.delta_ema(df.filter("Delta IS NOT NULL OR DateTime < '2024-01-02'"), 1).orderBy("DateTime").collect()][-1] == -3


def test_developing_poc(spark):
    rows = random_bars(400, 30)
    levels = flatten(bar_frame(spark, rows))
    found = {(r["symbol"], r["DateTime"]): (r["PocPrice"], r["PocVolume"]) for r in X.developing_poc(levels).collect()}
    expected = {}
    for symbol, group in by_symbol(rows).items():
        totals, day = {}, None
        for r in group:
            if r[1].date() != day:
                totals, day = {}, r[1].date()
            for price, _, _, volume, _ in r[8]:
                totals[price] = totals.get(price, 0) + volume
            if r[8]:
                expected[symbol, r[1]] = max(((p, v) for p, v in totals.items()), key=lambda x: (x[1], -x[0]))
    assert found == expected

from collections import defaultdict

import pytest
from frames import at, bar, bar_frame, level, random_bars

from tickloom.operators import lookback as L
from tickloom.operators.reshape import flatten, to_flat


def lookbacks(df):
    """{(symbol, time): [(time, price, close) of t-1, t-2, ...]}"""
    return {(r["symbol"], r["DateTime"]): [(e["timestamp"], e["Price"], e["Close"]) for e in r["lookback"]]
            for r in df.collect()}


def expected(rows, n):
    """Plain walk: per symbol in time order, each earlier bar stands for its lowest-priced level."""
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        found[r[0]].append(r)
    want = {}
    for symbol, bars in found.items():
        heads = [(b[1], min((x[0] for x in b[8]), default=None), b[5]) for b in bars]
        for i, b in enumerate(bars):
            want[(symbol, b[1])] = heads[max(0, i - n):i][::-1]
    return want


def test_head_is_lowest_price(spark):
    bars = bar_frame(spark, [bar("A", 0, levels=[level(1.25), level(1.0)]), bar("A", 1)])
    assert lookbacks(L.with_lookback(bars))[("A", at(1))] == [(at(0), 1.0, 10.0)]


@pytest.mark.parametrize("form", ["nested", "flat"])
def test_empty_profile_is_still_a_bar(spark, form):
    """min_by would lose the NULL-price row; the earlier bar must be there, with a NULL price."""
    bars = bar_frame(spark, [bar("A", 0, 7.0, []), bar("A", 1)])
    rows = L.level_lookback(bars) if form == "nested" else L.flat_lookback(flatten(bars))
    assert lookbacks(rows)[("A", at(1))] == [(at(0), None, 7.0)]


def test_short_history_has_fewer_entries(spark):
    bars = bar_frame(spark, [bar("A", i, float(i)) for i in range(3)])
    rows = L.with_lookback(bars, 10).collect()
    assert sorted((r["index"], len(r["lookback"])) for r in rows) == [(0, 0), (1, 1), (2, 2)]


def test_all_levels_share_one_lookback(spark):
    bars = bar_frame(spark, [bar("A", 0), bar("A", 1, levels=[level(1), level(2), level(3)])])
    rows = [r for r in L.level_lookback(bars).collect() if r["DateTime"] == at(1)]
    assert sorted(r["Price"] for r in rows) == [1, 2, 3]
    assert all(len(r["lookback"]) == 1 for r in rows)


def test_unsorted_input_uses_event_time(spark):
    """A bar that arrives late in the table still takes its place in time."""
    bars = bar_frame(spark, [bar("A", 2, 2.0), bar("A", 0, 0.0), bar("A", 1, 1.0)])
    assert lookbacks(L.with_lookback(bars))[("A", at(2))] == [(at(1), 10.0, 1.0), (at(0), 10.0, 0.0)]


@pytest.mark.parametrize("n", [1, 10])
@pytest.mark.parametrize("form", ["nested", "flat"])
def test_random_bars(spark, n, form):
    rows = random_bars()
    bars = bar_frame(spark, rows)
    df = L.level_lookback(bars, n) if form == "nested" else L.flat_lookback(flatten(bars), n)
    assert lookbacks(df) == expected(rows, n)


def test_entries_hold_all_columns(spark):
    bars = bar_frame(spark, [bar("A", 0), bar("A", 1)])
    fields = set(L.with_lookback(bars).schema["lookback"].dataType.elementType.names)
    assert {"timestamp", "Open", "High", "Low", "Close", "Volume", "Delta", "Price", "BidVol", "AskVol",
            "TotalVolume", "NumOfTrades"} == fields


def test_records(spark):
    records = L.market_records(L.level_lookback(bar_frame(spark, [bar("A", 0), bar("A", 1)])))
    rows = sorted(records.collect(), key=lambda r: r["current"]["index"])
    assert [r["current"]["index"] for r in rows] == [0, 1]
    assert rows[1]["current"]["timestamp"] == at(1)
    assert "index" in L.current_only(records).columns


def test_levels_are_not_shuffled_for_nested_bars(spark):
    """Flattening comes after every exchange."""
    plan = L.level_lookback(bar_frame(spark, [bar("A", 0)]))._jdf.queryExecution().sparkPlan().toString()
    generate = min(i for i, line in enumerate(plan.splitlines()) if "explode(VolumeByPrice" in line)
    join = min(i for i, line in enumerate(plan.splitlines()) if "Window" in line)
    assert generate < join


def test_arithmetic(spark):
    bars = bar_frame(spark, [bar("A", i, float(i * i), volume=10 * (i + 1)) for i in range(7)])
    change = {r["DateTime"]: r["CloseChange"] for r in L.close_change(bars).collect()}
    assert change[at(0)] is None and change[at(3)] == 5.0
    mean = {r["DateTime"]: r["AvgVolume5"] for r in L.mean_volume(bars, 5).collect()}
    assert mean[at(4)] is None and mean[at(5)] == 30.0
    # Ratios: none, 20/10, 30/15, 40/20, 50/30, ...
    assert {r["DateTime"] for r in L.rvol_alerts(bars, 1.9, 3).collect()} == {at(1), at(2), at(3)}


def test_flat_and_clean(spark):
    raw = bar_frame(spark, [bar("A", 0, levels=[level(2), level(1)]), bar("A", 1, levels=[])])
    raw = raw.withColumnRenamed("Close", "Last").withColumnRenamed("Delta", "ID2.SG1").selectExpr("*", "true IsBarClosed")
    flat = to_flat(raw)
    assert flat.count() == 3
    assert {"Close", "Delta"} <= set(flat.columns) and "IsBarClosed" not in flat.columns
    empty = flat.filter("Price IS NULL").collect()
    assert [(r["DateTime"], r["TotalVolume"]) for r in empty] == [(at(1), None)]
    assert "IsBarClosed" in to_flat(raw, drop=["nothing"]).columns

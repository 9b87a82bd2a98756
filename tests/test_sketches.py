"""Merged sketches against exact results, ranks of any scale, roles."""

import bisect
import random
from datetime import timedelta

import pytest
from frames import START
from pyspark.sql import functions as F

from tickloom.operators import features as X
from tickloom.operators import profile as P
from tickloom.operators import sequence as S
from tickloom.operators import sketches as K

ROWS = "symbol string, ts timestamp_ntz, price double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    out = [("hot", START + timedelta(days=r.randrange(20), seconds=r.randrange(3600)), r.gauss(100, 20)) for _ in range(20_000)]
    out += [("grid", START + timedelta(days=k % 20), float(r.choice([5, 5, 10, 20]))) for k in range(3000)]
    return out + [("hot", START, None), ("hot", START, float("nan")), (None, START, 1.0), ("late", None, 2.0)]


def test_sketches_of_days_merge_into_a_range(spark, rows):
    stored = K.daily_sketches(spark.createDataFrame(rows, ROWS).repartition(6), "price", "ts").persist()
    points = [0.01, 0.25, 0.5, 0.9, 0.999]
    for first, end in ((0, 20), (3, 9)):
        low, high = (START + timedelta(days=d) for d in (first, end))
        days = (F.col(K.DAY) >= F.lit(low.date())) & (F.col(K.DAY) < F.lit(high.date()))
        found = {r["symbol"]: r for r in K.profile(K.merged(stored.filter(days)), points, 3).collect()}
        for symbol in ("hot", "grid"):
            own = sorted(p for s, t, p in rows if s == symbol and t and low.date() <= t.date() < high.date() and p is not None and p == p)
            r = found[symbol]
            assert (r["n"], r["min"], r["max"]) == (len(own), own[0], own[-1])
            for p, q in zip(points, r["quantiles"]):
                below, upto = bisect.bisect_left(own, q) / len(own), bisect.bisect_right(own, q) / len(own)
                assert below <= p + K.RANK_ERROR and upto >= p - K.RANK_ERROR
            assert abs(r["distinct"] - len(set(own))) <= K.DISTINCT_ERROR * len(set(own)) + 1
        counts = {v: sum(1 for s, t, p in rows if s == "grid" and low.date() <= t.date() < high.date() and p == v) for v in (5.0, 10.0, 20.0)}
        assert {f["item"]: f["count"] for f in found["grid"]["frequent"]} == counts
    assert {r["symbol"] for r in K.merged(stored).collect()} == {"hot", "grid", None, "late"}
    assert K.daily_sketches(spark.createDataFrame([], ROWS), "price", "ts").count() == 0


def test_percent_rank_of_ratios(spark):
    """Values between 0 and 1 fall into as many pieces as values of any other scale."""
    r = random.Random(1)
    rows = [("a", k, r.choice([0.0, r.random(), 1e-9 * r.random()])) for k in range(700)] + [("b", 1, 0.5), ("b", 2, None), ("c", 1, None)]
    df = spark.createDataFrame(rows, "symbol string, k int, v double")
    own = sorted(x[2] for x in rows if x[0] == "a")
    for x in X.percent_rank(df, "v").collect():
        if x["symbol"] == "a":
            assert x["PercentRank"] == pytest.approx(bisect.bisect_left(own, x["v"]) / (len(own) - 1))
        else:
            assert x["PercentRank"] == (None if x["v"] is None else 0.0)
    plan = X.percent_rank(df, "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "FLOOR" in plan and "/ 256" not in plan
    assert X.percent_rank(df.filter("v IS NULL"), "v").filter("PercentRank IS NULL").count() == 2


def test_price_against_volume_by_role(spark):
    df = spark.createDataFrame([("x", 1.5, 3), ("y", None, 4), ("z", 2.5, None)], "price_note string, ClosePx double, TotalVol int")
    assert [tuple(r) for r in P.price_volume(df).collect()] == [("ClosePx", 1.5, "TotalVol", 3.0)]
    with pytest.raises(ValueError, match="volume"):
        P.price_volume(df.drop("TotalVol"))


@pytest.mark.parametrize("order", [["t", "v"], ["v", "t"], ["name", "t"]])
def test_position_slice_by_any_first_column(spark, order):
    r = random.Random(6)
    rows = [(START + timedelta(hours=r.randrange(900)) if r.random() > 0.05 else None, r.choice([-1.5, 1e9, r.random()]), r.choice("abcd") * 3)
            for _ in range(300)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double, name string")
    place = {"t": 0, "v": 1, "name": 2}
    ranked = sorted((tuple(x[place[c]] for c in order) for x in rows), key=lambda x: [(v is not None, v) if v is not None else (False,) for v in x])
    got = S.position_slice(df, order, F.expr("n_rows div 3"), 7).collect()
    assert sorted((tuple(g[c] for c in order) for g in got), key=str) == sorted(ranked[100:107], key=str)

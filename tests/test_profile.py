import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import profile as P
from tickloom.operators import quantiles as QT

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def frame():
    n = 3000
    data = pd.DataFrame({
        "a": RNG.normal(10, 3, n), "b": RNG.exponential(2, n).round(1), "c": RNG.integers(0, 4, n).astype(float),
        "d": np.full(n, 7.0), "heavy": np.where(RNG.random(n) < 0.4, 5.0, RNG.standard_cauchy(n) * 1e6),
    })
    data.loc[::7, "a"] = np.nan
    data.loc[::11, "b"] = np.nan
    return data


@pytest.fixture(scope="module")
def df(spark, frame):
    from tickloom.functions.columns import nan_to_null

    return nan_to_null(spark.createDataFrame(frame)).repartition(5).persist()


@pytest.mark.parametrize("bins, few", [(1 << 13, 4096), (256, 10), (1 << 13, 0)])
def test_quantiles_are_exact(df, frame, monkeypatch, bins, few):
    monkeypatch.setattr(QT, "BINS", bins)
    monkeypatch.setattr(QT, "FEW", few)
    probabilities = [0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1]
    found = QT.exact_quantiles(df, list(frame.columns), probabilities)
    for c in frame.columns:
        for p in probabilities:
            assert math.isclose(found[(c, p)], frame[c].quantile(p), rel_tol=1e-12), (c, p)


def scans(monkeypatch, run):
    """How many scans a selection took, and the most rows that one interval gave."""
    seen, scan = [], QT._scan

    def counted(values, intervals, parts):
        out = scan(values, intervals, parts)
        sizes = [r["count"] for r in out.groupBy("interval").count().collect()]
        seen.append(max(sizes, default=0))
        return out

    monkeypatch.setattr(QT, "_scan", counted)
    return run(), seen


def test_quantiles_of_any_doubles(spark, monkeypatch):
    """Values over the whole range of doubles, hot ones, and neighbours that differ in their last bit: five scans at most."""
    near = [math.nextafter(1.0, 2) if k % 2 else 1.0 for k in range(400)]
    wild = [s * 10.0 ** e for e in range(-320, 309) for s in (1, -1)] + [0.0, -0.0, 5e-324, -5e-324, math.inf, -math.inf]
    hot = [7.0] * 5000 + [float(k) for k in range(300)]
    values = [("near", v) for v in near] + [("wild", v) for v in wild] + [("hot", v) for v in hot]
    made = spark.createDataFrame([tuple(v if c == n else None for n in ("near", "wild", "hot")) for c, v in values],
                                 "near double, wild double, hot double").repartition(3)
    probabilities = [0, 0.001, 0.1, 0.3, 0.5, 0.77, 0.999, 1]
    monkeypatch.setattr(QT, "FEW", 0)
    found, seen = scans(monkeypatch, lambda: QT.exact_quantiles(made, ["near", "wild", "hot"], probabilities))
    for name, own in (("near", near), ("wild", wild), ("hot", hot)):
        ranked = sorted(own)
        for p in probabilities:
            at = p * (len(own) - 1)
            low, high = ranked[math.floor(at)], ranked[math.ceil(at)]
            expected = low + (high - low) * (at - math.floor(at))
            assert found[name, p] == expected or math.isnan(expected)
    assert len(seen) <= 5


def test_no_task_reads_more_than_a_histogram(spark, monkeypatch):
    monkeypatch.setattr(QT, "BINS", 512)
    monkeypatch.setattr(QT, "FEW", 300)
    made = spark.range(60_000, numPartitions=4).selectExpr("rand(3) * id AS x")
    found, seen = scans(monkeypatch, lambda: QT.exact_quantiles(made, ["x"], [0.25, 0.5]))
    ranked = sorted(r["x"] for r in made.collect())
    assert found["x", 0.5] == (ranked[29_999] + ranked[30_000]) / 2
    assert max(seen) <= 4 * 512, "parts of an interval, once per task"


def test_quantiles_of_counts(spark):
    counts = spark.createDataFrame([(5, 1000), (7, 1), (-3, 999)], "value bigint, n bigint").repartition(2)
    assert QT.quantiles_of_counts(counts, [0.0, 0.5, 1.0]) == {0.0: -3.0, 0.5: 5.0, 1.0: 7.0}
    assert QT.quantiles_of_counts(counts.limit(0), [0.5]) == {}


def test_statistics_of_an_empty_table(spark):
    none = spark.createDataFrame([], "x double, y bigint")
    assert [tuple(r) for r in P.wide_stats(none, ["x"], {"n": lambda c: F.count(c), "m": lambda c: F.avg(c)}).collect()] == [("x", 0, 0, None)]
    assert [tuple(r) for r in P.correlation(none).collect()] == [("x", "y", None)] and P.correlation(none, ["x"]).count() == 0


def test_quantiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert QT.exact_quantiles(df, ["x", "y"], [0.5]) == {("y", 0.5): 1.0}
    assert {r["column"]: r["m"] for r in QT.quantile_columns(df, ["x", "y"], {"m": 0.5}).collect()} == {
        "x": None, "y": 1.0}


def test_moments_match_pandas(df, frame):
    found = {r["column"]: r for r in P.moments(df).collect()}
    for c in ("a", "b", "c"):
        assert math.isclose(found[c]["skewness"], frame[c].skew(), rel_tol=1e-9)
        assert math.isclose(found[c]["kurtosis"], frame[c].kurtosis(), rel_tol=1e-9)
        assert math.isclose(found[c]["variance"], frame[c].var(), rel_tol=1e-9)


def test_correlation_is_pairwise_complete(df, frame):
    want = frame.corr()
    found = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation(df, ["a", "b", "c"]).collect()}
    assert all(math.isclose(r, want.loc[a, b], rel_tol=1e-9) for (a, b), r in found.items())


def test_correlation_may_take_longer_than_a_broadcast(spark):
    def wait(batches):
        for batch in batches:
            time.sleep(5)
            yield batch

    slow = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double").coalesce(1).mapInArrow(wait, "x double, y double")
    settings = {"spark.sql.broadcastTimeout": "3", "spark.sql.adaptive.enabled": "false"}  # adaptive plans take the shuffle out of the broadcast
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = [(r["col_a"], r["col_b"], round(r["r"], 9)) for r in P.high_correlation(slow).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == [("x", "y", 1.0)]


def test_correlation_with_one_value_only(spark):
    """NaN, as the SQL form has it: alone, with a value that tasks' means miss by a bit, and only where the other side is present."""
    rows = [(0.0, 0.1 * 3, float(k), 5.0 if k % 2 else float(k), None if k % 2 == 0 else 2.0 * k, 1e-200 * k) for k in range(343)]
    made = spark.createDataFrame(rows, "zero double, flat double, x double, half double, odd double, tiny double").repartition(7)
    found = {(r["col_a"], r["col_b"]): r["r"] for r in P.correlation(made).collect()}
    assert len(found) == 15
    assert all(math.isnan(r) for pair, r in found.items() if {"zero", "flat", "tiny"} & {*pair} or pair == ("half", "odd"))
    assert math.isclose(found["x", "odd"], 1.0) and math.isclose(
        found["x", "half"], np.corrcoef([r[2] for r in rows], [r[3] for r in rows])[0, 1])
    high = [(r["col_a"], r["col_b"]) for r in P.high_correlation(made, ["zero", "x", "odd"]).collect()]
    assert sorted(high) == [("x", "odd"), ("zero", "odd"), ("zero", "x")]
    one = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert [tuple(r) for r in P.correlation(one).collect()] == [("x", "y", None)]


def test_histogram_matches_numpy(df, frame):
    found = sorted((r["column"], r["bin"], r["n"]) for r in P.histogram(df, ["a", "c", "d"], 20).collect())
    want = []
    for c in ("a", "c", "d"):
        counts, _ = np.histogram(frame[c].dropna(), bins=20)
        want += [(c, i, int(n)) for i, n in enumerate(counts)]
    assert found == want


def test_shape_limits(spark):
    rows = spark.createDataFrame([(0.5,), (-0.5,), (0.49,), (None,), (0.51,)], "s double")
    labels = [r[0] for r in rows.select(P.skew_label(F.col("s"))).collect()]
    assert labels == ["Left Skewed", "Left Skewed", "Approximately Normal", "Left Skewed", "Right Skewed"]
    tails = spark.createDataFrame([(3.0,), (3.1,), (-1.0,), (-1.1,), (None,)], "k double")
    assert [r[0] for r in tails.select(P.tail_label(F.col("k"))).collect()] == [
        "Normal Tails", "Heavy Tailed", "Normal Tails", "Light Tailed", "Normal Tails"]


def test_outlier_summary(df, frame):
    found = {r["column"]: r for r in P.outlier_summary(df).collect()}
    for c in frame.columns:
        x = frame[c]
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        assert found[c]["iqr_n"] == ((x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))).sum()
        assert found[c]["z_n"] == (((x - x.mean()) / x.std()).abs() > 3).sum()


def test_missing_and_uniqueness(df, frame):
    assert {r["column"]: r["n"] for r in P.missing(df).collect()} == {
        c: int(n) for c, n in frame.isnull().sum().items() if n}
    totals = P.missing_totals(df).first()
    assert totals["total"] == frame.isnull().sum().sum()
    assert math.isclose(totals["complete_pct"], (1 - frame.isnull().any(axis=1).mean()) * 100)
    assert {r["column"]: r["n_unique"] for r in P.uniqueness(df).collect()} == dict(frame.nunique())


def test_boxplot_and_qq(df, frame):
    box = {r["column"]: r for r in P.boxplot(df, ["b"]).collect()}["b"]
    x = frame["b"].dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    assert box["whisker_hi"] == x[x <= q3 + 1.5 * (q3 - q1)].max()
    rows = P.qq(df, "a", 9).orderBy("p").collect()
    assert math.isclose(rows[4]["normal_q"], 0, abs_tol=1e-12)
    assert math.isclose(rows[4]["sample_q"], frame["a"].median(), rel_tol=1e-12)


def test_feature_flags(df):
    flags = {r["column"]: (r["high_var"], r["skewed"], r["constant"]) for r in P.feature_flags(df).collect()}
    assert flags["d"][2] and not flags["a"][2]
    assert flags["b"][1]

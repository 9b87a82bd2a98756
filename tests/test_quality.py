from datetime import timedelta

import pytest
from frames import START, at, bar, bar_frame

from tickloom.operators import quality as Q


def prices(spark, rows):
    return spark.createDataFrame(rows, "Open double, High double, Low double, Close double, Volume bigint")


def times(spark, rows):
    return spark.createDataFrame(rows, "symbol string, DateTime timestamp_ntz, Price double")


def test_schema(spark):
    found = {r["column"]: (r["severity"], r["present"]) for r in Q.schema_check(prices(spark, [])).collect()}
    assert found["Open"] == ("issue", True) and found["RVOL"] == ("warning", False)
    assert Q.schema_check(prices(spark, []).drop("Low")).filter("severity = 'issue' AND NOT present").count() == 1


def test_ohlc(spark):
    df = prices(spark, [(1.0, 0.5, 1.0, 1.0, 1), (1.0, None, 1.0, 1.0, -1), (1.0, 2.0, 0.5, 1.0, None)])
    assert Q.ohlc_check(df).first()["n_bad"] == 1
    assert Q.volume_check(df).first()["n_bad"] == 1
    assert {r["column"]: r["nulls"] for r in Q.null_counts(df).collect()} == {"High": 1, "Volume": 1}


def test_gaps_by_grain(spark):
    """Three level rows at 09:30 and three at 09:45: the median step is 0 on levels, so the bar step is a gap."""
    df = times(spark, [("A", at(i), float(p)) for i in (0, 1) for p in range(3)])
    level, by_bar = Q.gap_check(df, "level").first(), Q.gap_check(df, "bar").first()
    assert (level["n_gaps"], level["median_s"], level["max_gap_s"]) == (1, 0.0, 900)
    assert (by_bar["n_gaps"], by_bar["median_s"], by_bar["max_gap_s"]) == (0, 900.0, None)
    with pytest.raises(ValueError):
        Q.gap_check(df, "tick")


def test_gap_is_strictly_more_than_ten_medians(spark):
    steps = [0, 1, 2, 12, 23]
    df = times(spark, [("A", START + timedelta(seconds=60 * s), 1.0) for s in steps])
    row = Q.gap_check(df).first()
    # Steps 60, 60, 600, 660: the median is 330.
    assert (row["median_s"], row["n_gaps"]) == (330.0, 0)
    df = times(spark, [("A", START + timedelta(seconds=s), 1.0) for s in (0, 1, 2, 3, 13, 24)])
    row = Q.gap_check(df).first()
    assert (row["median_s"], row["n_gaps"], row["max_gap_s"]) == (1.0, 1, 11)


def test_gap_between_seconds(spark):
    moments = [START + timedelta(milliseconds=900 * i) for i in range(5)] + [START + timedelta(seconds=8.6)]
    row = Q.gap_check(times(spark, [("A", t, 1.0) for t in moments])).first()
    assert (row["median_s"], row["n_gaps"]) == (0.9, 0)
    moments.append(START + timedelta(seconds=18))
    row = Q.gap_check(times(spark, [("A", t, 1.0) for t in moments])).first()
    assert (row["median_s"], row["n_gaps"], row["max_gap_s"]) == (0.9, 1, 9.4)


def test_single_time_has_no_steps(spark):
    row = Q.gap_check(times(spark, [("A", at(0), 1.0)])).first()
    assert (row["n_gaps"], row["median_s"]) == (0, None)


def test_outliers(spark):
    df = prices(spark, [(1.0, 1.0, 1.0, float(i % 2), 1) for i in range(100)] + [(1.0, 1.0, 1.0, 100.0, 1)])
    assert Q.outlier_check(df).first()["n"] == 1
    assert Q.outlier_check(prices(spark, [(1.0, 1.0, 1.0, None, 1)])).first()["n"] == 0


def test_report(spark):
    good = bar_frame(spark, [bar("A", i) for i in range(4)])
    rows = {(r["check"], r["column"]) for r in Q.report(good).collect()}
    assert rows == {("optional_columns", c) for c in ("RVOL", "Price", "CumulativeDelta")}
    assert Q.verdict(Q.report(good))
    assert not Q.verdict(Q.report(good.drop("Open")))
    negative = bar_frame(spark, [bar("A", 0, volume=-3)])
    assert not Q.verdict(Q.report(negative))


def test_path_in_one_call(spark, tmp_path):
    (tmp_path / "good.csv").write_text("when,Open,High,Low,Close,Volume\n2024-01-02 10:00:00,1,2,1,2,5\n2024-01-02 10:01:00,1,2,1,2,5\n")
    rows, passed = Q.validate_path(spark, str(tmp_path / "good.csv"))
    first = rows.first()
    assert passed and (first["n"], first["detail"]) == (2, "6 columns, 2024-01-02 10:00:00 to 2024-01-02 10:01:00")
    (tmp_path / "bad.csv").write_text("when,Open,High,Low,Close,Volume\n2024-01-02 10:00:00,1,2,3,2,5\nnever,1,2,1,2,-5\n")
    rows, passed = Q.validate_path(spark, str(tmp_path / "bad.csv"))
    assert not passed and {r["check"] for r in rows.collect()} >= {"table", "ohlc", "volume", "nulls"}


def test_backward_steps_within_and_across_blocks(spark):
    seconds = [0, 5, 3, 4, 2, 9, 9, 1]
    df = spark.createDataFrame([(i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)],
                               "n bigint, t timestamp_ntz")
    want = sum(b < a for a, b in zip(seconds, seconds[1:]))
    for block in (1, 2, 3, 100):
        assert Q.backward_steps(df, "n", "t", block).first()["n_backward_steps"] == want


def test_quarantine(spark):
    raw = spark.createDataFrame([
        ("2024-01-01 09:30:00", "1.5", "3"), ("soon", "1.5", "3"), ("2024-01-01 09:30:00", "x", "3"),
        ("2024-01-01 09:30:00", "1.5", "-3"), ("2024-01-01 09:30:00", None, None),
    ], "DateTime string, Price string, TotalVolume string")
    assert [r["reason"] for r in Q.quarantine(raw).collect()] == ["ok", "bad_time", "bad_price", "bad_volume", "ok"]

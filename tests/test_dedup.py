from frames import at

from tickloom.operators import dedup as D

SCHEMA = "symbol string, DateTime timestamp_ntz, value double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_same_values_at_different_times(spark):
    """The original ignored the time; ours does so only on request."""
    df = frame(spark, [("A", at(1), 1.0), ("A", at(0), 1.0)])
    assert [r["DateTime"] for r in D.first_occurrences(df, include_time=False).collect()] == [at(0)]
    assert D.first_occurrences(df).count() == 2


def test_null_values_are_equal(spark):
    df = frame(spark, [("A", at(0), None), ("A", at(0), None), ("A", at(1), None)])
    assert D.first_occurrences(df).count() == 2
    assert D.first_occurrences(df, include_time=False).count() == 1


def test_unseen_rows(spark):
    seen = frame(spark, [("A", at(0), 1.0), ("B", at(0), None)])
    new = frame(spark, [("A", at(1), 1.0), ("B", at(1), None), ("A", at(3), 2.0), ("A", at(2), 2.0)])
    by_value = D.unseen(new, seen, include_time=False).collect()
    assert [(r["symbol"], r["DateTime"], r["value"]) for r in by_value] == [("A", at(2), 2.0)]
    assert D.unseen(new, seen).count() == 4
    assert D.unseen(seen, seen).count() == 0


def test_empty_batch(spark):
    seen = frame(spark, [("A", at(0), 1.0)])
    assert D.unseen(frame(spark, []), seen).count() == 0


def test_no_join_and_partial_aggregation(spark):
    df = frame(spark, [("A", at(0), 1.0)])
    plan = D.unseen(df, df, include_time=False)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_" in plan


def test_duplicate_count(spark):
    rows = [("A", at(0), 1.0)] * 97 + [("A", at(1), None)] * 2 + [("B", at(0), 1.0)]
    row = D.duplicate_count(frame(spark, rows)).first()
    assert (row["n"], row["pct"]) == (97, 97.0)

import pytest
from frames import at, bar, bar_frame, level, random_bars
from pyspark.errors import PySparkException

from tickloom.functions import columns as C
from tickloom.operators import bars as B
from tickloom.operators import reshape as R
from tickloom.schemas import PROFILE
from tickloom.sources import files, sinks


@pytest.fixture
def flat(spark):
    bars = bar_frame(spark, [bar("A", 1, levels=[level(2), level(1)]), bar("A", 0, levels=[])])
    return R.to_flat(bars)


def test_csv_round_trip(spark, flat, tmp_path):
    path = sinks.write_csv(flat, str(tmp_path / "history"))
    back = files.read_history_csv(spark, path)
    order = ["DateTime", "Price"]
    assert back.select(flat.columns).orderBy(order).collect() == flat.orderBy(order).collect()
    again = sinks.write_csv(flat.limit(1), path)
    assert files.read_history_csv(spark, again).count() == 1


def test_csv_without_known_columns_or_schema(spark, tmp_path):
    (tmp_path / "x.csv").write_text("DateTime,Close,note\n2024-01-02 00:00:00,NaN,b\n2024-01-01 00:00:00,1.5,a\n")
    path = str(tmp_path / "x.csv")
    explicit = files.read_history_csv(spark, path)
    assert dict(explicit.dtypes) == {"DateTime": "timestamp_ntz", "Close": "double", "note": "string"}
    assert explicit.filter("Close IS NULL").count() == 1
    assert files.read_history_csv(spark, path, schema=None).filter("Close = 1.5").count() == 1


def test_bad_times(spark, tmp_path):
    (tmp_path / "x.csv").write_text("DateTime,Close\nyesterday,1.5\n2024-01-01 00:00:00,1.0\n")
    path = str(tmp_path / "x.csv")
    with pytest.raises(PySparkException):
        files.read_history_csv(spark, path).collect()
    assert files.read_history_csv(spark, path, strict=False).filter("DateTime IS NULL").count() == 1
    (tmp_path / "y.csv").write_text("When,Close\n2024-01-01 00:00:00,1.0\n")
    with pytest.raises(ValueError):
        files.read_history_csv(spark, str(tmp_path / "y.csv"))
    indexed = files.read_indexed_csv(spark, str(tmp_path / "y.csv"))
    assert indexed.filter("DateTime IS NOT NULL").count() == 1


def test_export(spark, flat, tmp_path):
    path = sinks.export_features(flat, str(tmp_path / "out"), "parquet")
    back = spark.read.parquet(path)
    assert back.count() == flat.count()
    assert (tmp_path / "out" / "symbol=A" / "trade_date=2024-01-01").exists()
    plan = back.filter("trade_date = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan
    assert sinks.export_features(flat, folder=str(tmp_path), fmt="csv").endswith(".csv")
    with pytest.raises(ValueError):
        sinks.export_features(flat, fmt="hdf5")


def test_info(flat):
    info = sinks.data_info(flat, "live")
    assert info["shape"] == (3, len(flat.columns))
    assert info["date_range"] == (at(0), at(1))
    assert [r["Price"] for r in info["head"]] == [None, 1.0, 2.0]


def test_bar_table_joins_without_shuffle(spark):
    bars = bar_frame(spark, random_bars(40, 5))
    sinks.write_bar_table(bars.drop(PROFILE), "bar_table", 4)
    sinks.write_bar_table(R.flatten(bars).select("symbol", "DateTime", "Price"), "level_table", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bar_table").join(spark.table("level_table"), ["symbol", "DateTime"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positional_levels(spark):
    rows = [("A", [[1.0, 2.0, 3.0, 5.0, 1.0], [2.0, 0.0, 1.0, 1.0, 1.0]]), ("B", [])]
    df = spark.createDataFrame(rows, f"symbol string, {PROFILE} array<array<double>>")
    flat = R.flatten(files.levels_from_lists(df)).orderBy("symbol", "Price").collect()
    assert [(r["Price"], r["TotalVolume"]) for r in flat] == [(1.0, 5), (2.0, 1), (None, None)]


def test_modes(spark, flat, tmp_path):
    path = sinks.write_csv(flat, str(tmp_path / "h"))
    assert files.Pipeline(spark, {"df": flat}).run() is flat
    assert files.Pipeline(spark, {"df": flat, "file_path": path}).mode is files.Mode.LIVE
    assert files.Pipeline(spark, {"file_path": path}).run().count() == 3
    for config, mode in (({}, files.Mode.AUTO), ({"df": flat}, files.Mode.TRAINING),
                         ({"file_path": path}, files.Mode.LIVE)):
        with pytest.raises(ValueError):
            files.Pipeline(spark, config, mode)
    with pytest.raises(TypeError):
        files.Pipeline(spark, {"df": [1, 2]}).run()


def test_column_roles(spark):
    df = spark.createDataFrame([("x", "2024-01-01", 1.0, 2)], "update string, tradeDate string, ClosePx double, vol int")
    assert C.columns_with_role(df, "price") == ["ClosePx"]
    assert C.columns_with_role(df, "volume") == ["vol"]
    assert C.first_date_column(df) == "tradeDate"
    assert C.numeric_columns(df) == ["ClosePx", "vol"]
    assert C.first_date_column(df.drop("tradeDate")) is None


def test_session_hours(spark):
    rows = [("2024-01-01 07:59:59",), ("2024-01-01 08:00:00",), ("2024-01-01 15:00:00",),
            ("2024-01-01 15:00:00.000001",), ("2024-01-01 23:30:00",)]
    df = spark.createDataFrame(rows, "t string").selectExpr("CAST(t AS timestamp_ntz) AS DateTime")
    assert R.session_hours(df).count() == 2
    assert R.session_hours(df, "23:00:00", "08:00:00").count() == 3


def test_bars_break_ties_by_trade_number(spark):
    rows = [("A", at(0), 2, 20.0, 1, "ask"), ("A", at(0), 1, 10.0, 5, "bid"), ("A", at(0), -3, 30.0, 2, "ask")]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id bigint, price double, size bigint, side string")
    for made in (B.ohlcv(df), B.nested_bars(df)):
        row = made.first()
        assert (row["Open"], row["High"], row["Low"], row["Close"]) == (30.0, 30.0, 10.0, 20.0)
        assert (row["Volume"], row["Delta"], row["Trades"]) == (8, -2, 3)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert B.ohlcv(df).first()["Open"] == 30.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_invariants(spark, sf_dir):
    """Level volumes add up to bar volumes, deltas to the last cumulative delta, prices are ordered."""
    from tickloom.plans import inputs as I

    bars = B.with_cumulative_delta(I.nested(spark, sf_dir)).persist()
    flat = R.flatten(bars)
    per_bar = flat.groupBy("symbol", "DateTime", "Volume").agg({"TotalVolume": "sum"})
    assert per_bar.filter("Volume <> `sum(TotalVolume)`").count() == 0
    assert bars.filter("Low > Open OR Low > Close OR High < Open OR High < Close").count() == 0
    last = bars.selectExpr("symbol", "struct(DateTime, CumulativeDelta) AS c", "Delta").groupBy("symbol").agg(
        {"c": "max", "Delta": "sum"}).collect()
    assert all(r["max(c)"]["CumulativeDelta"] == r["sum(Delta)"] for r in last)
    assert bars.filter("NOT IsBarClosed").count() == bars.select("symbol").distinct().count()
    bars.unpersist()

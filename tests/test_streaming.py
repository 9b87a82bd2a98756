import os

import pytest
from frames import BARS, at, bar, bar_frame, level, random_bars
from pyspark.sql import functions as F
from test_lookback import lookbacks

from tickloom.operators import bars as B
from tickloom.operators.lookback import with_lookback
from tickloom.session import checkpoint_location, checkpoint_root
from tickloom.streaming import live
from tickloom.streaming.lookback import bootstrap, stream_lookback


class Feed:
    """A folder that receives files in order; each file is one micro-batch."""

    def __init__(self, spark, folder, schema=BARS):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        os.makedirs(folder, exist_ok=True)

    def add(self, rows):
        self.n += 1
        target = f"{self.folder}/{self.n:05d}.json"
        df = self.spark.createDataFrame(rows, self.schema)
        text = [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()]
        with open(target + ".part", "w") as f:
            f.write("\n".join(text))
        os.rename(target + ".part", target)
        os.utime(target, (1_700_000_000 + self.n, 1_700_000_000 + self.n))

    def stream(self):
        return (self.spark.readStream.format("json").schema(self.schema).option("maxFilesPerTrigger", 1)
                .option("pathGlobFilter", "*.json").load(self.folder))


def drain(stream, path, label):
    query = live.append_files(stream, path, label=label, available_now=True)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def in_order(rows):
    return sorted(rows, key=lambda r: r[1])


def chunks(rows, n):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


@pytest.mark.parametrize("batches", [1, 3, 12])
def test_stream_equals_batch(spark, tmp_path, batches):
    rows = in_order(random_bars(60, 12))
    feed = Feed(spark, str(tmp_path / "in"))
    for part in chunks(rows, batches):
        feed.add(part)
    out = drain(stream_lookback(feed.stream(), 4), str(tmp_path / "out"), f"equal-{batches}-{tmp_path.name}")
    batch = with_lookback(bar_frame(spark, rows), 4)
    assert lookbacks(out) == lookbacks(batch)
    position = {(r["symbol"], r["DateTime"]): r["index"] for r in out.collect()}
    assert position == {(r["symbol"], r["DateTime"]): r["index"] for r in batch.collect()}
    mine = {(r["symbol"], r["DateTime"]): (r["Open"], r["Volume"], r["VolumeByPrice"]) for r in out.collect()}
    assert mine == {(r[0], r[1]): (r[2], r[6], [tuple(x) for x in r[8]]) for r in rows}


def test_restart_repeats_and_loses_nothing(spark, tmp_path):
    rows = in_order(random_bars(40, 8))
    feed, label = Feed(spark, str(tmp_path / "in")), f"restart-{tmp_path.name}"
    for part in chunks(rows, 4):
        feed.add(part)
        out = drain(stream_lookback(feed.stream(), 3), str(tmp_path / "out"), label)
    assert out.count() == len(rows)
    assert lookbacks(out) == lookbacks(with_lookback(bar_frame(spark, rows), 3))


def test_bootstrap_goes_on_from_history(spark, tmp_path):
    rows = in_order(random_bars(50, 10))
    cut = rows[len(rows) // 2][1]
    history = bar_frame(spark, [r for r in rows if r[1] < cut])
    start = bootstrap(history, 5)
    schema = start.schema
    feed = Feed(spark, str(tmp_path / "in"), schema)
    feed.add([tuple(r) for r in start.collect()])
    feed.add([(*r, None) for r in rows if r[1] >= cut])
    out = drain(stream_lookback(feed.stream(), 5).filter(F.col("DateTime") >= F.lit(cut)), str(tmp_path / "out"),
                f"boot-{tmp_path.name}")
    want = with_lookback(bar_frame(spark, rows), 5).filter(F.col("DateTime") >= F.lit(cut))
    assert lookbacks(out) == lookbacks(want)
    assert {r["index"] for r in out.collect()} == {r["index"] for r in want.collect()}


def test_late_bar_goes_to_quarantine(spark, tmp_path):
    """A bar older than what was seen neither enters the lookback nor gets one."""
    feed = Feed(spark, str(tmp_path / "in"))
    feed.add([bar("A", 0), bar("A", 2)])
    feed.add([bar("A", 1), bar("A", 3)])
    kept = stream_lookback(feed.stream(), 5, keep_late=True)
    out = drain(kept, str(tmp_path / "out"), f"late-{tmp_path.name}")
    late = {r["DateTime"]: r["late"] for r in out.collect()}
    assert late == {at(0): False, at(1): True, at(2): False, at(3): False}
    last = out.filter(F.col("DateTime") == F.lit(at(3))).first()
    assert [e["timestamp"] for e in last["lookback"]] == [at(2), at(0)]


def test_entries_keep_their_types(spark, tmp_path):
    """Whole numbers beyond 2^53, text and NULLs come back from the state as they were; a bar without a time is late."""
    schema = "symbol string, DateTime timestamp_ntz, Volume bigint, Note string, Close double"
    rows = [("A", at(0), (1 << 53) + 1, 'a "b", c', 0.1), ("A", at(1), None, None, float("nan")), ("A", at(2), 5, "", 1e300)]
    feed = Feed(spark, str(tmp_path / "in"), schema)
    feed.add(rows[:1])
    feed.add([*rows[1:], ("A", None, 1, "x", 1.0)])
    kept = stream_lookback(feed.stream(), 3, ["Volume", "Note", "Close"], keep_late=True)
    out = {r["DateTime"]: r for r in drain(kept, str(tmp_path / "out"), f"types-{tmp_path.name}").collect()}
    assert [tuple(e) for e in out[at(1)]["lookback"]] == [(at(0), (1 << 53) + 1, 'a "b", c', 0.1)]
    assert [str(e) for e in out[at(2)]["lookback"][0]] == [str(at(1)), "None", "None", "nan"]
    assert [r["late"] for r in out.values()].count(True) == 1 and out[None]["late"]


def test_live_loop_keeps_late_bars(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"))
    feed.add([bar("A", 0), bar("A", 2)])
    feed.add([bar("A", 1), bar("A", 3)])
    path = str(tmp_path / "out")
    live.run_live(feed.stream(), path, label=f"keep-{tmp_path.name}", available_now=True, keep_late=True).awaitTermination()
    rows = {(r["DateTime"], r["late"]) for r in spark.read.parquet(path).collect()}
    assert rows == {(at(0), False), (at(1), True), (at(2), False), (at(3), False)}


RAW = BARS + ", IsBarClosed boolean"


def test_live_levels_on_close(spark, tmp_path):
    """Open bars do not pass, a repeated bar passes once, levels carry the lookback."""
    feed = Feed(spark, str(tmp_path / "in"), RAW)
    first, second = bar("A", 0, levels=[level(2), level(1)]), bar("A", 1, levels=[])
    feed.add([(*first, True), (*second, False)])
    feed.add([(*first, True), (*second, True)])
    out = drain(live.live_levels(feed.stream(), 3, ["Price", "Close"]), str(tmp_path / "out"),
                f"levels-{tmp_path.name}")
    rows = out.orderBy("DateTime", "Price").collect()
    assert [(r["DateTime"], r["Price"]) for r in rows] == [(at(0), 1.0), (at(0), 2.0), (at(1), None)]
    assert [e["Price"] for e in rows[2]["lookback"]] == [1.0]
    assert "IsBarClosed" not in out.columns


def test_ticks_pass_without_lookback(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), RAW)
    feed.add([(*bar("A", 0), False), (*bar("A", 0), False)])
    out = drain(live.live_levels(feed.stream(), on_bar_close=False), str(tmp_path / "out"), f"tick-{tmp_path.name}")
    assert out.count() == 2 and "lookback" not in out.columns


def test_csv_append_writes_current_columns(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"))
    feed.add([bar("A", 0), bar("A", 1)])
    path = str(tmp_path / "csv")
    live.run_live(feed.stream(), path, fmt="csv", label=f"csv-{tmp_path.name}", available_now=True).awaitTermination()
    feed.add([bar("A", 2)])
    live.run_live(feed.stream(), path, fmt="csv", label=f"csv-{tmp_path.name}", available_now=True).awaitTermination()
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 3 and "lookback" not in back.columns and "Price" in back.columns


def test_callback_route_and_monitor(spark, tmp_path, caplog):
    schema = "subscription_id int, " + BARS
    feed = Feed(spark, str(tmp_path / "in"), schema)
    feed.add([(1, *bar("A", 0)), (2, *bar("B", 0)), (3, *bar("C", 0))])
    seen = {1: [], 2: []}
    handlers = {i: (lambda df, i=i: seen[i].extend(r["symbol"] for r in df.collect())) for i in seen}
    live.route(feed.stream(), handlers, label=f"route-{tmp_path.name}", available_now=True).awaitTermination()
    assert seen == {1: ["A"], 2: ["B"]}
    assert any("without a handler" in r.getMessage() for r in caplog.records)

    shown = []
    own = live.of_subscription(feed.stream(), 1)
    live.monitor(own, lambda df, batch: shown.extend(df.collect()), f"mon-{tmp_path.name}", True).awaitTermination()
    assert [r["symbol"] for r in shown] == ["A"]

    def fail(df, batch):
        raise RuntimeError("stop here")

    query = live.deliver(feed.stream(), fail, f"fail-{tmp_path.name}", available_now=True)
    with pytest.raises(Exception):
        query.awaitTermination()
    got = []
    live.deliver(feed.stream(), lambda df, batch: got.extend(df.collect()), f"fail-{tmp_path.name}",
                 available_now=True).awaitTermination()
    assert len(got) == 3


TRADES = "symbol string, ts timestamp_ntz, trade_id bigint, price double, size bigint, side string"


def test_late_trades_are_dropped_and_counted(spark, tmp_path):
    feed = Feed(spark, str(tmp_path / "in"), TRADES)
    feed.add([("A", at(0), 1, 1.0, 1, "ask")])
    feed.add([("A", at(20), 2, 2.0, 1, "ask")])
    # Spark drops by the watermark of the batch before, so one more batch has to pass.
    feed.add([("A", at(20), 5, 2.5, 1, "ask")])
    feed.add([("A", at(0), 3, 9.0, 1, "ask"), ("A", at(30), 4, 3.0, 1, "ask")])
    made = live.plain_time(live.bars_from_trades(feed.stream()))
    query = live.append_files(made, str(tmp_path / "out"), label=f"trades-{tmp_path.name}", available_now=True)
    query.awaitTermination()
    out = {r["DateTime"]: (r["Close"], r["Volume"]) for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect()}
    assert out == {at(0): (1.0, 1), at(20): (2.5, 2)}
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 1


def test_closed_stream_bars_equal_batch_bars(spark, tmp_path):
    rows = [("A", at(i // 3), i, float(i % 5), i % 7 + 1, "ask" if i % 2 else "bid") for i in range(60)]
    feed = Feed(spark, str(tmp_path / "in"), TRADES)
    for part in chunks(rows, 4):
        feed.add(part)
    feed.add([("A", at(1000), 99, 1.0, 1, "ask")])
    out = drain(live.plain_time(live.bars_from_trades(feed.stream())), str(tmp_path / "out"), f"bars-{tmp_path.name}")
    batch = B.ohlcv(spark.createDataFrame(rows, TRADES))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select(out.columns).collect()))


def test_newest_versions_equal_batch_bars(spark, tmp_path):
    """Open bars included; bars that change in several batches count with their last version."""
    rows = [("A", at(i // 7), i, float(i % 5), i % 7 + 1, "ask" if i % 2 else "bid") for i in range(60)]
    feed = Feed(spark, str(tmp_path / "in"), TRADES)
    for part in chunks(rows, 5):
        feed.add(part)
    made = live.plain_time(live.bars_from_trades(feed.stream()))
    live.update_files(made, str(tmp_path / "out"), f"newest-{tmp_path.name}", available_now=True).awaitTermination()
    out = live.newest(spark, str(tmp_path / "out"), made.schema, ["symbol", "DateTime"]).select(made.columns)
    batch = B.ohlcv(spark.createDataFrame(rows, TRADES)).select(made.columns)
    assert spark.read.parquet(str(tmp_path / "out")).count() > batch.count()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_location(spark, "x") == f"{checkpoint_root(spark)}/x"
    assert checkpoint_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

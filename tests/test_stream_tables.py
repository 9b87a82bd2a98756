"""Streams whose state is tables: history and updates in one call, crashes, late and repeated rows, merging, routing."""

import pytest
from frames import BARS, at, bar, bar_frame, level, random_bars
from pyspark.sql import functions as F
from test_lookback import lookbacks
from test_streaming import RAW, Feed, chunks, in_order

from tickloom.operators.lookback import with_lookback
from tickloom.sources.folders import matching, remove
from tickloom.streaming import live, tables


def run(feed, path, state, label, n=4, **options):
    def write(rows, batch):
        rows.write.mode("overwrite").parquet(f"{path}/{tables.BATCH}={batch}")
        if options.get("crash") == batch:
            raise RuntimeError("lost after writing")

    given = {k: v for k, v in options.items() if k != "crash"}
    return tables.run_lookback(feed.stream(), write, state, n, label=label, available_now=True, **given)


def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "state"), f"tables-{tmp_path.name}"


def same_as_batch(spark, path, rows, n=4):
    out, batch = spark.read.parquet(path), with_lookback(bar_frame(spark, rows), n)
    assert out.count() == len(rows) and lookbacks(out) == lookbacks(batch)
    assert {(r["symbol"], r["DateTime"]): r["index"] for r in out.collect()} == {
        (r["symbol"], r["DateTime"]): r["index"] for r in batch.collect()}


@pytest.mark.parametrize("batches", [1, 5])
def test_equals_batch(spark, tmp_path, batches):
    rows = in_order(random_bars(60, 12))
    feed = Feed(spark, str(tmp_path / "in"))
    for part in chunks(rows, batches):
        feed.add(part)
    path, state, label = folders(tmp_path)
    run(feed, path, state, label).awaitTermination()
    same_as_batch(spark, path, rows)
    versions = matching(spark, f"{state}/version=*")
    assert len(versions) == min(2, batches), "older versions are gone"
    assert spark.read.parquet(versions[-1]).groupBy("symbol").count().filter("count > 4").count() == 0


def test_history_and_updates_in_one_call(spark, tmp_path):
    rows = in_order(random_bars(60, 12))
    feed, (path, state, label) = Feed(spark, str(tmp_path / "in")), folders(tmp_path)
    history = bar_frame(spark, rows[:40])
    for part in chunks(rows[40:], 3):
        feed.add(part)
        run(feed, path, state, label, history=history).awaitTermination()
    same_as_batch(spark, path, rows)


def test_crash_between_result_and_state(spark, tmp_path):
    rows = in_order(random_bars(60, 12))
    feed, (path, state, label) = Feed(spark, str(tmp_path / "in")), folders(tmp_path)
    for part in chunks(rows, 3):
        feed.add(part)
    with pytest.raises(Exception, match="lost after writing"):
        run(feed, path, state, label, crash=1).awaitTermination()
    run(feed, path, state, label).awaitTermination()
    same_as_batch(spark, path, rows)


def test_late_repeated_and_untimed_bars(spark, tmp_path):
    feed, (path, state, label) = Feed(spark, str(tmp_path / "in")), folders(tmp_path)
    feed.add([bar("A", 0), bar("A", 2), bar("A", 2)])
    untimed = ("A", None, *bar("A", 0)[2:])
    feed.add([bar("A", 1), bar("A", 2), bar("A", 3), untimed, untimed, bar("B", 0)])
    run(feed, path, state, label, keep_late=True).awaitTermination()
    out = spark.read.parquet(path).collect()
    assert sorted((r["symbol"], str(r["DateTime"]), r["late"], r["index"]) for r in out) == sorted([
        ("A", str(at(0)), False, 0), ("A", str(at(2)), False, 1), ("A", str(at(1)), True, None), ("A", str(at(3)), False, 2),
        ("A", "None", True, None), ("A", "None", True, None), ("B", str(at(0)), False, 0)])
    last = next(r for r in out if r["DateTime"] == at(3))
    assert [e["timestamp"] for e in last["lookback"]] == [at(2), at(0)]


def test_live_loop_on_close(spark, tmp_path):
    """Open bars do not pass, a repeated bar passes once, levels carry the lookback."""
    feed = Feed(spark, str(tmp_path / "in"), RAW)
    first, second = bar("A", 0, levels=[level(2), level(1)]), bar("A", 1, levels=[])
    feed.add([(*first, True), (*second, False)])
    feed.add([(*first, True), (*second, True)])
    path = str(tmp_path / "out")
    live.run_live(feed.stream(), path, 3, ["Price", "Close"], label=f"close-{tmp_path.name}", available_now=True).awaitTermination()
    rows = spark.read.parquet(path).orderBy("DateTime", "Price").collect()
    assert [(r["DateTime"], r["Price"]) for r in rows] == [(at(0), 1.0), (at(0), 2.0), (at(1), None)]
    assert [e["Price"] for e in rows[2]["lookback"]] == [1.0] and "IsBarClosed" not in rows[0].asDict()


EVENTS = "id bigint, DateTime timestamp_ntz, v string"


def test_unseen_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "MERGED_RUNS", 2)
    feed, (path, seen, label) = Feed(spark, str(tmp_path / "in"), EVENTS), folders(tmp_path)
    rows = [(k, at(40 * k), "x" if k % 3 else None) for k in range(20)] + [(99, None, "x"), (None, at(0), None)]
    rounds = [rows[:8] + rows[:2], rows[5:12], rows[12:20] + rows[:1], rows, [(0, at(0), "other"), (1, at(41), "x")]]
    for part in rounds:
        feed.add(part)
    tables.run_unseen(feed.stream(), path, seen, label=label, available_now=True).awaitTermination()
    schema = spark.createDataFrame([], EVENTS).schema
    found = tables.read_batches(spark, path, schema)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, {*rows, *rounds[-1]}))
    runs = tables._runs(spark, seen)
    assert len(runs) < 5 and max(r[1] for r in runs) >= 1, "runs were merged"
    hashes = tables._seen(spark, [r[2] for r in runs], [])
    assert hashes.distinct().count() == len({*rows, *rounds[-1]})


def test_unseen_after_a_crash(spark, tmp_path, monkeypatch):
    feed, (path, seen, label) = Feed(spark, str(tmp_path / "in"), EVENTS), folders(tmp_path)
    rows = [(k, at(k), "x") for k in range(10)]
    for part in (rows[:5], rows[3:8], rows):
        feed.add(part)
    whole, written = tables._write_run, []

    def lose_second(hashes, folder):
        whole(hashes, folder)
        written.append(folder)
        if len(written) == 2:
            raise RuntimeError("lost behind the hashes")

    monkeypatch.setattr(tables, "_write_run", lose_second)
    with pytest.raises(Exception, match="lost behind the hashes"):
        tables.run_unseen(feed.stream(), path, seen, label=label, available_now=True).awaitTermination()
    tables.run_unseen(feed.stream(), path, seen, label=label, available_now=True).awaitTermination()
    found = tables.read_batches(spark, path, spark.createDataFrame([], EVENTS).schema)
    assert sorted(tuple(r) for r in found.collect()) == rows


def test_unseen_without_time(spark, tmp_path):
    feed, (path, seen, label) = Feed(spark, str(tmp_path / "in"), EVENTS), folders(tmp_path)
    feed.add([(1, at(0), None), (None, at(1), "x")])
    feed.add([(1, at(500), None), (None, at(900), "x"), (2, at(0), "x")])
    tables.run_unseen(feed.stream(), path, seen, include_time=False, label=label, available_now=True).awaitTermination()
    found = tables.read_batches(spark, path, spark.createDataFrame([], EVENTS).schema)
    assert sorted((str(r["id"]), str(r["v"])) for r in found.collect()) == [("1", "None"), ("2", "x"), ("None", "x")]


def test_days_that_a_batch_does_not_touch_are_not_read(spark, tmp_path):
    feed, (path, seen, label) = Feed(spark, str(tmp_path / "in"), EVENTS), folders(tmp_path)
    feed.add([(k, at(96 * k), "x") for k in range(9)])
    tables.run_unseen(feed.stream(), path, seen, label=label, available_now=True).awaitTermination()
    runs = [r[2] for r in tables._runs(spark, seen)]
    read = tables._seen(spark, runs, ["2024-01-03", "2030-01-01"]).inputFiles()
    assert len(read) == 1 and "__day=2024-01-03" in read[0]


def test_route_writes_once(spark, tmp_path):
    schema = "subscription_id int, " + BARS
    feed = Feed(spark, str(tmp_path / "in"), schema)
    feed.add([(1, *bar("A", 0)), (2, *bar("B", 0)), (3, *bar("C", 0)), (None, *bar("D", 0))])
    feed.add([(1, *bar("A", 1))])
    seen = {1: [], 2: []}
    handlers = {i: (lambda df, i=i: seen[i].extend((r["symbol"], len(df.inputFiles()), df.columns) for r in df.collect())) for i in seen}
    path = str(tmp_path / "routed")
    live.route(feed.stream(), handlers, label=f"route-{tmp_path.name}", available_now=True, path=path).awaitTermination()
    columns = [c for c in feed.stream().columns if c != "subscription_id"]
    assert seen == {1: [("A", 1, columns)] * 2, 2: [("B", 1, columns)]}
    rows = live.routed(spark, path, feed.stream().schema)
    assert sorted((r["symbol"], r[live.ROUTE]) for r in rows.collect()) == [
        ("A", "id-1"), ("A", "id-1"), ("B", "id-2"), ("C", "unknown"), ("D", "none")]
    plan = rows.filter(F.col(live.ROUTE) == "id-1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and len(rows.filter(F.col(live.ROUTE) == "id-2").inputFiles()) >= 1
    assert matching(spark, f"{path}/*/_SUCCESS"), "the commit mark of a batch"


def test_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    assert matching(spark, str(tmp_path / "none" / "*")) == []
    assert [p.rsplit("/", 1)[1] for p in matching(spark, str(tmp_path / "*"))] == ["a"]
    remove(spark, str(tmp_path / "a"))
    remove(spark, str(tmp_path / "a"))
    assert matching(spark, str(tmp_path / "*")) == []

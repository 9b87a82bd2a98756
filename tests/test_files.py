"""Histories in several layouts, rows that cannot be read, exports that replace their own days."""

import gzip

import pytest
from frames import at, bar, bar_frame, random_bars
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickloom.sources import files, sinks
from tickloom.sources.folders import matching


def put(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())


@pytest.fixture
def mixed(tmp_path):
    folder = tmp_path / "history"
    put(folder, "a.csv", "DateTime,Open,Close\n2024-01-01 00:00:00,1.5,2\n")
    put(folder, "b.csv", "﻿DateTime,Close,Open,Volume\n2024-01-02 00:00:00,3,4,5\n2024-01-03 00:00:00,6,,7\n")
    put(folder, "c.csv.gz", 'Close,DateTime,"a, note"\n8,2024-01-04 00:00:00,"x, y"\n')
    put(folder, "d.csv", "")
    put(folder, "e.csv", "DateTime,Open,Close\n")
    return str(folder)


def test_files_meet_by_column_name(spark, mixed):
    groups = files.header_groups(spark, mixed)
    assert [(h, len(f)) for h, f in groups.items()] == [
        (("DateTime", "Open", "Close"), 2), (("DateTime", "Close", "Open", "Volume"), 1), (("Close", "DateTime", "a, note"), 1)]
    df = files.read_history_csv(spark, mixed)
    assert dict(df.dtypes) == {"DateTime": "timestamp_ntz", "Open": "double", "Close": "double", "Volume": "bigint", "a, note": "string"}
    rows = sorted((str(r["DateTime"])[8:10], r["Open"], r["Close"], r["Volume"], r["a, note"]) for r in df.collect())
    assert rows == [("01", 1.5, 2.0, None, None), ("02", 4.0, 3.0, 5, None), ("03", None, 6.0, 7, None), ("04", None, 8.0, None, "x, y")]


def test_indexed_files_meet_by_column_name(spark, tmp_path):
    folder = tmp_path / "indexed"
    put(folder, "a.csv", "When,Open,Close\n2024-01-01 00:00:00,1,2\nnever,3,4\n")
    put(folder, "b.csv", "When,Close,Open\n2024-01-02 00:00:00,5,6\n")
    df = files.read_indexed_csv(spark, str(folder))
    assert sorted((r["Open"], r["Close"], r["DateTime"] is None) for r in df.collect()) == [(1.0, 2.0, False), (3.0, 4.0, True), (6.0, 5.0, False)]
    assert dict(df.dtypes)["Open"] == "double"
    put(folder, "c.csv", "x,DateTime\n1,2\n")
    with pytest.raises(ValueError, match="first column"):
        files.read_indexed_csv(spark, str(folder))


def test_headers_that_cannot_be_read(spark, tmp_path):
    for name, text in (("twice", "DateTime,Open,Open\n"), ("empty", ""), ("untimed", "Open\n1\n")):
        put(tmp_path / name, "x.csv", text)
        with pytest.raises(ValueError):
            files.read_history_csv(spark, str(tmp_path / name))


def test_types_that_differ(spark, tmp_path):
    put(tmp_path / "t", "a.csv", "DateTime,n,m\n2024-01-01 00:00:00,1,1\n")
    put(tmp_path / "t", "b.csv", "n,m,DateTime\n1.5,x,2024-01-01 00:00:00\n")
    df = files.read_history_csv(spark, str(tmp_path / "t"), schema=None)
    assert dict(df.dtypes)["n"] == "double" and dict(df.dtypes)["m"] == "string"
    assert sorted((r["n"], r["m"]) for r in df.collect()) == [(1.0, "1"), (1.5, "x")]


def test_bad_rows_are_set_aside(spark, tmp_path):
    folder = tmp_path / "bad"
    lines = ["2024-01-01 00:00:00,1.5,2", "yesterday,1,2", "2024-01-02 00:00:00,abc,2", "2024-01-03 00:00:00,1,2.5x",
             "2024-01-04 00:00:00,1", "2024-01-05 00:00:00,1,2,3", ",1,2", "2024-01-06 00:00:00,,", "never,x,y"]
    put(folder, "a.csv", "DateTime,Close,Volume\n" + "\n".join(lines) + "\n")
    put(folder, "b.csv", "Volume,DateTime,Close\n7,2024-01-07 00:00:00,1\nz,2024-01-08 00:00:00,1\n")
    good, rejects = files.split_history_csv(spark, str(folder), str(tmp_path / "target"))
    assert dict(good.dtypes) == {"DateTime": "timestamp_ntz", "Close": "double", "Volume": "bigint"}
    assert sorted((str(r["DateTime"])[8:10], r["Close"], r["Volume"]) for r in good.collect()) == [
        ("01", 1.5, 2), ("06", None, None), ("07", 1.0, 7)]
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in rejects.collect())
    assert found == sorted([
        ("a.csv", lines[1], "DateTime"), ("a.csv", lines[2], "Close"), ("a.csv", lines[3], "Volume"),
        ("a.csv", lines[4], "number of fields"), ("a.csv", lines[5], "number of fields"), ("a.csv", lines[6], "DateTime"),
        ("a.csv", lines[8], "DateTime, Close, Volume"), ("b.csv", "z,2024-01-08 00:00:00,1", "Volume")])
    # Two files fail, in either order: a cell's error comes bare from the reader, a time's from the plan
    with pytest.raises((PySparkException, Py4JJavaError), match="MALFORMED_RECORD|CANNOT_PARSE"):
        files.read_history_csv(spark, str(folder)).collect()


def exported(spark, path):
    return sorted((r["symbol"], r["DateTime"], r["Close"]) for r in sinks.read_days(spark, path).collect())


def test_a_repeated_export_replaces_its_own_days(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path / "export"), random_bars(80, 9)
    days = bar_frame(spark, rows).select("symbol", "DateTime", "Close")
    assert sinks.export_days(days, path) == 1
    assert exported(spark, path) == sorted((r[0], r[1], r[5]) for r in rows)
    cut = sorted(r[1] for r in rows)[50].replace(hour=0, minute=0)
    later = days.filter((F.col("DateTime") >= F.lit(cut)) & (F.col("symbol") == "hot")).withColumn("Close", F.col("Close") + 1)
    touched = {r["DateTime"].date() for r in later.collect()}
    assert sinks.export_days(later, path) == 2 and sinks.export_days(later, path) == 3
    expected = [(r[0], r[1], r[5]) for r in rows if r[1].date() not in touched]
    expected += [(r["symbol"], r["DateTime"], r["Close"]) for r in later.collect()]
    assert exported(spark, path) == sorted(expected)
    assert len(matching(spark, f"{path}/run=*")) == 2, "runs that no day needs are gone"

    def crash(*_):
        raise RuntimeError("lost before the manifest")

    monkeypatch.setattr(sinks, "_manifest", crash)
    with pytest.raises(RuntimeError):
        sinks.export_days(days.withColumn("Close", F.lit(0.0)), path)
    monkeypatch.undo()
    assert exported(spark, path) == sorted(expected)


def test_exports_are_pruned(spark, tmp_path):
    path = str(tmp_path / "export")
    sinks.export_days(bar_frame(spark, [bar("A", 0), bar("A", 200), bar("B", 200), ("C", None, *bar("C", 0)[2:])]).drop("VolumeByPrice"), path)
    one = sinks.read_days(spark, path).filter("trade_date = '2024-01-03' AND symbol = 'A'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and one.count() == 1
    assert [r["symbol"] for r in sinks.read_days(spark, path).filter("trade_date = 'none'").collect()] == ["C"]
    assert at(200).day == 3
    with pytest.raises(ValueError):
        sinks.read_days(spark, str(tmp_path / "none"))

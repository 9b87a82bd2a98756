"""What the physical plans of the registered queries must and must not contain."""

import re

import pytest

import __spark_entry__ as entry
from tickloom.operators import bars as B
from tickloom.operators import features as X
from tickloom.operators import lookback as L
from tickloom.plans import inputs as I
from tickloom.schemas import TIME

BATCH = sorted(n for n in entry.queries() if not n.startswith("stream"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert not re.search("NestedLoop|Cartesian|BatchEvalPython|ArrowEvalPython|InPandas", text)


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(entry.queries()["date_cutoff"](spark, small))
    assert "GreaterThanOrEqual(ts," in text
    schema = re.findall(r"ReadSchema: (\S+)", plan(entry.queries()["bar_delta"](spark, small)))
    assert "value" not in schema[0]
    corr = re.findall(r"FileScan parquet \[([^\]]*)\]", plan(entry.queries()["eda_corr"](spark, small)))
    assert set(re.findall(r"l_[a-z]+", corr[0])) == set(I.LINEITEM_NUMBERS)


@pytest.mark.parametrize("name", ["lookback_t1", "rvol", "cumulative_delta", "delta_ema", "breakout", "clean_columns"])
def test_history_windows_never_hold_a_symbol(spark, small, name):
    """Only the daily totals are windowed per symbol; rows are windowed per day or block."""
    text = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    for line in text.splitlines():
        if "Window [" not in line or "__t_" in line:
            continue
        partition = re.search(r"\], \[([^\[\]]*)\], \[[^\[\]]*\]$", line).group(1).split(", ")
        assert len(partition) > 1, line


def test_one_prefix_sum_serves_several_operators(spark, small):
    """Signals behind the cumulative delta do not count positions again."""
    bars = B.with_cumulative_delta(I.bars(spark, small))
    for df in (X.delta_divergence(bars, "index"), X.breakout(bars, position="index"), X.delta_slope(bars, position="index"),
               L.with_lookback(bars, 2, position="index")):
        assert plan(df).count("FileScan") <= 2


def test_bars_and_levels_aggregate_by_hash(spark, small):
    """Open and close use a decimal key; a struct key would sort the trades."""
    assert "SortAggregate" not in plan(I.bars(spark, small))
    assert "SortAggregate" not in plan(I.levels(spark, small))


def test_point_of_control_keeps_one_level_before_the_sort_ends(spark, small):
    text = plan(entry.queries()["poc"](spark, small))
    assert "WindowGroupLimit" in text and "max_by" not in text


def test_last_bars_are_limited_before_the_shuffle(spark, small):
    text = plan(entry.queries()["bars_last_n"](spark, small))
    assert "WindowGroupLimit" in text and TIME in text

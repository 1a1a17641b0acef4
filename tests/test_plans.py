"""The shape of the physical plans: shuffles, joins and what reaches the scan."""

import re

import pytest

from tailspark import Settings
from tailspark.plans import features, reports
from tailspark.sources import adapters

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text)


@pytest.fixture(scope="module")
def tables(spark):
    return adapters.model_tables(spark, FOLDER)


def test_panel_shuffles_once_by_ticker(spark, tables):
    text = plan(features.with_rolling_features(features.base_panel(tables), Settings(), with_targets=True))
    by_ticker = [e for e in exchanges(text) if re.fullmatch(r"ticker#\d+", e)]
    assert len(by_ticker) == 1
    # one sort serves the as-of step and every rolling window
    assert len(re.findall(r"Sort \[ticker#\d+ ASC NULLS FIRST, date#\d+ ASC NULLS FIRST", text)) == 1
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_python_in_the_panel(spark, tables):
    text = plan(features.with_rolling_features(features.base_panel(tables), Settings()))
    assert "Python" not in text and "ArrowEval" not in text


def test_scans_read_only_needed_columns(spark, tables):
    text = tables["benchmark_prices"]._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["l_extendedprice", "l_quantity", "l_shipdate"]


def test_weekly_cut_is_a_hash_aggregation(spark, tables):
    from tailspark.operators.resample import weekly_prices

    text = plan(weekly_prices(tables["prices"]))
    assert "SortAggregate" not in text and text.count("partial_max") >= 1


def test_year_filter_prunes_folders(spark, tables, tmp_path):
    from tailspark.operators.resample import weekly_prices
    from tailspark.sources import sinks

    sinks.write_parquet_by_year(weekly_prices(tables["prices"]), str(tmp_path / "w"))
    text = plan(spark.read.parquet(str(tmp_path / "w")).where("year = 1998"))
    assert re.search(r"PartitionFilters: \[.*year#\d+ = 1998", text)


def test_rolling_subset_drops_unused_windows(spark, tables):
    rolled = features.with_rolling_features(features.base_panel(tables), Settings())
    text = plan(rolled.select("ticker", "date", "beta"))
    assert "collect_list" not in text and "controversy_rolling" not in text


def test_short_reports_use_top_k(spark, tables):
    panel = features.base_panel(tables)
    assert "TakeOrderedAndProject" in plan(reports.sector_controversy(panel))

"""What the panel's rows move, and rules that float noise must not decide."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tailspark import Settings, catalog
from tailspark.plans import features
from tailspark.sources import adapters

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_are_made_behind_the_last_shuffle(spark):
    text = plan(features.labelled_panel(adapters.model_tables(spark, FOLDER)))
    wide = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    windows = max(i for i, line in enumerate(text.splitlines()) if "Window [" in line)
    first = min(i for i, line in enumerate(text.splitlines()) if "Window [" in line)
    assert wide and windows > first
    # nothing is shuffled between the scan of the result and the rolling windows
    assert not any("Exchange hashpartitioning" in line for line in text.splitlines()[:first])
    assert "SortMergeJoin" not in "\n".join(text.splitlines()[:first])


def test_a_score_equal_to_its_mean_is_no_spike(spark):
    rows = [("A", f"2020-{m:02d}-{d:02d}", 10 * k / 7) for k in (1, 2, 3, 5, 6) for m in (1,) for d in range(1, 29)]
    rows = [(f"T{i // 28}", d, s) for i, (_, d, s) in enumerate(rows)]
    base = spark.createDataFrame(rows, "ticker string, date string, controversy_score double").select(
        "ticker", F.to_date("date").alias("date"), "controversy_score", F.lit("X").alias("sector"),
        *[F.lit(0.01).alias(c) for c in ("weekly_return", "benchmark_return", "firm_specific_return", "turnover")],
    )
    loose = features.with_rolling_features(base, Settings())
    firm = features.with_rolling_features(base, Settings(spike_margin=1e-9))
    assert firm.agg(F.sum("controversy_spike_flag")).first()[0] == 0
    assert loose.agg(F.sum("controversy_spike_flag")).first()[0] > 0


def test_prices_do_not_depend_on_the_order_of_lines(spark, tmp_path):
    cents = [(i, 1, 100001.0 + i * 17 % 991 / 100 + i, 3.0, "1995-01-02") for i in range(500)]
    schema = "l_orderkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate string"
    found = set()
    for n, rows in enumerate((cents, cents[::-1], cents[250:] + cents[:250])):
        folder = str(tmp_path / str(n))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        found.add(adapters.prices(spark, folder).first().adj_close)
    assert len(found) == 1


def test_scenario_prices_are_compared_to_ten_digits(spark):
    wide = spark.createDataFrame([(56872168201.49792, 1.5), (56872168201.49812, 1.5000004)], "x double, y double")
    rows = catalog.rounded_to_digits(wide, ("x", "y")).collect()
    assert rows[0].x == rows[1].x and rows[0].y == rows[1].y == 1.5
    assert "log10" in entry.oracle_sql()["price_scenarios"]


def test_copies_of_the_row_at_the_threshold_are_labelled_alike(spark):
    # each of ten values forty times, the copies apart by float noise as sums in another order leave them
    panel = spark.range(400).select(
        F.lit("1995-01-06").cast("date").alias("date"),
        (F.floor(F.col("id") / 40) + (F.col("id") % 40) * 1e-13).alias("future_ncskew"),
    )

    def labelled_of_value(margin):
        rows = features.with_labels(panel, 0.21, margin=margin).groupBy(F.round("future_ncskew").alias("v"))
        return {r.v: r.n for r in rows.agg(F.sum("high_crash_risk").alias("n")).collect()}

    assert 0 < labelled_of_value(0.0)[7.0] < 40
    assert labelled_of_value(catalog.LABEL_MARGIN) == {float(v): 40 if v >= 7 else 0 for v in range(10)}
    assert f"- {catalog.LABEL_MARGIN}" in entry.oracle_sql()["fit_certificate"]


def test_queries_of_a_few_columns_write_no_wide_panel(spark):
    catalog.forget()
    rows = catalog.panel(spark, FOLDER).where("high_crash_risk is not null").select("ticker", "date", "lagged_ncskew")
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "controversy_rolling" not in text and "trailing_return" not in text and "lagged_ncskew" in text
    entry.queries()["split_evaluation"](spark, FOLDER).collect()
    entry.queries()["one_feature_fit"](spark, FOLDER).collect()
    assert not {"dataset", "model_rows"} & {name for _, _, name in catalog._STAGED}
    # a session that has the whole panel reads it
    whole = catalog.dataset(spark, FOLDER)
    assert catalog.panel(spark, FOLDER) is whole
    assert catalog.labelled(spark, FOLDER).exceptAll(whole).isEmpty()


def test_data_summary_reads_stored_raw_tables(spark):
    text = plan(entry.queries()["data_summary"](spark, FOLDER))
    assert "lineitem" not in text and "orders" not in text and "stored_prices" in text

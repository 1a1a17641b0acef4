import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tailspark.plans import features, run
from tailspark.sources import loaders


@pytest.fixture(scope="module")
def loaded(spark, raw, small):
    return loaders.load_tables(spark, raw, small)


@pytest.fixture(scope="module")
def dataset(loaded, small):
    return features.labelled_panel(loaded, small).cache()


def test_panel_rows_and_labels(dataset):
    assert dataset.count() == 42 * 3
    labels = {r.high_crash_risk for r in dataset.select("high_crash_risk").distinct().collect()}
    assert labels == {0, 1, None}
    by_date = dataset.where("high_crash_risk is not null").groupBy("date").agg(F.sum("high_crash_risk").alias("n"))
    assert {r.n for r in by_date.collect()} == {1}


def test_fundamentals_wait_for_their_date(dataset):
    caps = {r.date: r.market_cap for r in dataset.where("ticker = 'AAA'").collect()}
    assert caps[dt.date(2020, 8, 7)] == 10e9 and caps[dt.date(2020, 8, 14)] == pytest.approx(10.5e9)


def test_later_rows_do_not_change_earlier_features(spark, loaded, small, dataset):
    cut = dt.date(2020, 6, 5)
    changed = dict(loaded)
    changed["prices"] = loaded["prices"].withColumn(
        "adj_close", F.when(F.col("date") > F.lit(cut), F.col("adj_close") * 3).otherwise(F.col("adj_close"))
    )
    changed["controversies"] = loaded["controversies"].withColumn(
        "controversy_score", F.when(F.col("date") > F.lit(cut), F.lit(99.0)).otherwise(F.col("controversy_score"))
    )
    columns = ["ticker", "date", *small.features]
    again = features.feature_panel(changed, small).where(F.col("date") <= F.lit(cut)).select(*columns)
    before = dataset.where(F.col("date") <= F.lit(cut)).select(*columns)
    assert before.exceptAll(again).isEmpty() and again.exceptAll(before).isEmpty()


def test_rolling_features_match_pandas(dataset):
    pdf = dataset.where("ticker = 'CCC'").orderBy("date").toPandas()
    ret = pdf.weekly_return
    assert (ret.rolling(6, min_periods=3).std() * 52**0.5 - pdf.realized_volatility).abs().max() < 1e-9
    assert pdf.realized_volatility.notna().equals(ret.rolling(6, min_periods=3).count().ge(3))
    trend = pdf.turnover.rolling(6, min_periods=3).mean()
    assert (pdf.turnover - trend - pdf.detrended_turnover).abs().max() < 1e-12
    mean = pdf.controversy_score.rolling(13, min_periods=1).mean()
    assert (mean - pdf.controversy_rolling_mean_13w).abs().max() < 1e-12
    assert (pdf.controversy_score.diff(4) - pdf.controversy_change_4w).abs().max() < 1e-12


def test_whole_run_writes_every_table(spark, csv_folder, small, tmp_path):
    (tmp_path / "news").mkdir()
    text = tmp_path / "news" / "news_text.csv"
    text.write_text(
        "ticker,date,source,headline,description\n"
        'CCC,2020-02-07,Wire,Fraud lawsuit widens,"Regulators open a bribery probe, analysts see loss"\n'
        "CCC,2020-06-05,Wire,Fraud lawsuit widens,Emissions scandal and pollution fines\n"
        "AAA,2020-02-07,Wire,Award for clean progress,Safe plants improve award wins\n"
        "AAA,2020-09-04,Wire,Award for clean progress,Settled claims benefit holders\n"
    )
    result = run.run(
        spark,
        loaders.discover_sources(spark, csv_folder),
        str(text),
        settings=replace(small, cv_folds=2),
        model_types=("logistic_regression",),
    )
    run.write(result, str(tmp_path / "processed"), str(tmp_path / "outputs"), str(tmp_path / "json"))
    expected = {
        "stock_scores", "price_history", "price_scenarios", "esg_model_comparison", "text_model_comparison",
        "algorithm_comparison", "hyperparameter_tuning_results", "confusion_matrix", "calibration_curve",
        "feature_importance", "business_analysis", "business_portfolio_returns", "quarter_backtest_returns",
        "quarter_excluded_stocks", "data_summary", "cleaning_log", "feature_descriptive_stats",
        "feature_correlation_matrix", "sql_summary", "textual_analysis", "textual_ticker_summary",
        "text_coverage", "lda_topic_words", "lda_ticker_topics", "textual_bigram_terms",
    }
    written = {p.name.removesuffix(".csv") for p in (tmp_path / "outputs").iterdir()}
    assert expected <= written
    assert {p.name for p in (tmp_path / "json").iterdir()} == written | {"metadata"}
    back = spark.read.parquet(str(tmp_path / "processed" / "feature_panel.parquet"))
    assert back.count() == result.panel.count() == 126
    scores = result.tables["stock_scores"].collect()
    assert [r.risk_bucket for r in sorted(scores, key=lambda r: -r.crash_probability)] == ["High", "Medium", "Medium"]
    assert {r.as_of_date for r in scores} == {"2020-10-16"}
    assert all(len(r.top_drivers.split(";")) == 3 for r in scores)
    scenarios = result.tables["price_scenarios"].collect()
    assert all(r.price_p05 <= r.price_p50 <= r.price_p95 for r in scenarios)
    assert {r.model for r in result.tables["esg_model_comparison"].collect()} == {
        "baseline_no_esg", "full_with_esg", "full_minus_baseline",
    }
    coverage = {r.split: r for r in result.tables["text_coverage"].collect()}
    assert coverage["overall"].article_count == 4 and coverage["overall"].unique_tickers == 2
    summary = [r.negative_esg_controversy_score_0_100 for r in result.tables["textual_ticker_summary"].collect()]
    assert summary == sorted(summary, reverse=True)
    bigrams = {(r.sentiment_bucket, r.bigram) for r in result.tables["textual_bigram_terms"].collect()}
    assert ("bearish", "fraud lawsuit") in bigrams and ("bullish", "clean progress") in bigrams


def test_run_without_text(spark, raw, small):
    result = run.run(spark, raw, settings=small, model_types=("logistic_regression",))
    assert result.tables["textual_analysis"].first().status == "no_text_file"
    assert result.tables["text_coverage"].first().split == "overall"
    assert result.model.trained_rows == sum(result.model.class_balance.values())

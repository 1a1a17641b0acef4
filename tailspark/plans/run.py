"""The whole batch: raw tables to features, labels, models, backtests and report tables."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.config import Settings
from tailspark.plans import features, modelling, portfolio, quality, reports, text
from tailspark.session import build_session
from tailspark.sources import loaders, sinks
from tailspark.staging import stage

# Result tables with at most a few hundred rows leave as one CSV file, the rest as folders.
SHORT = {
    "esg_model_comparison", "text_model_comparison", "algorithm_comparison",
    "hyperparameter_tuning_results", "confusion_matrix", "calibration_curve", "feature_importance",
    "business_analysis", "data_summary", "cleaning_log", "feature_descriptive_stats",
    "feature_correlation_matrix", "sql_summary", "text_coverage", "lda_topic_words",
    "textual_bigram_terms", "quarter_backtest_returns", "quarter_backtest_summary",
}


# Tables whose files come out in order; reports keep the order that they are made in.
ORDERED = {
    "price_history": ("ticker", "date"),
    "business_portfolio_returns": ("date",),
    "quarter_backtest_returns": ("date",),
    "textual_analysis": ("ticker", "date"),
}


@dataclass(frozen=True)
class RunResult:
    panel: DataFrame
    dataset: DataFrame
    model: modelling.TrainedModel
    tables: dict[str, DataFrame]


def run(
    spark: SparkSession,
    sources: dict[str, str | DataFrame],
    text_source: str | DataFrame | None = None,
    settings: Settings | None = None,
    tune: bool = False,
    model_types: tuple[str, ...] = modelling.MODEL_TYPES,
    list_excluded: bool = False,
) -> RunResult:
    """All tables of a run. Nothing is written but staged intermediates; see `write`."""
    settings = settings or Settings()
    raw = {name: stage(loaders.read_table(spark, source), f"raw_{name}") for name, source in sources.items()}
    loaded = {name: stage(df, name) for name, df in loaders.load_tables(spark, raw, settings).items()}
    files = {n: s for n, s in sources.items() if isinstance(s, str)}

    news = loaders.load_text(spark, text_source)
    weekly = stage(text.weekly_text(news.texts, news.source_file), "weekly_text") if news.texts is not None else None
    labelled = text.attach_text_signals(features.labelled_panel(loaded, settings), weekly)
    dataset = stage(labelled, "dataset", order_by=["date", "ticker"])
    panel = dataset.drop("future_ncskew", "future_duvol", "high_crash_risk")

    trained = modelling.train_classifier(dataset, settings, tune=tune)
    scores = stage(modelling.score_latest(trained.model, panel), "scores")
    scored = modelling.score_panel(trained.model, panel)
    overlay = stage(portfolio.forward_overlay(scored, list_excluded=list_excluded), "overlay")
    diagnostics = modelling.test_diagnostics(dataset, settings)

    tables = {
        "stock_scores": scores,
        "price_history": reports.price_history(panel),
        "price_scenarios": reports.price_scenarios(panel, scores, settings.horizon),
        "esg_model_comparison": modelling.compare_esg_lift(dataset, settings),
        "text_model_comparison": modelling.compare_text_lift(dataset, settings),
        "algorithm_comparison": modelling.compare_algorithms(dataset, settings, model_types),
        "hyperparameter_tuning_results": modelling.tuning_results(dataset, settings, model_types, tune),
        "confusion_matrix": diagnostics["confusion"],
        "calibration_curve": diagnostics["calibration"],
        "feature_importance": trained.importance_table(spark),
        "business_analysis": business_rows(overlay),
        "business_portfolio_returns": overlay,
        "data_summary": quality.data_summary(raw, loaded, panel, dataset, scores, files, settings),
        "cleaning_log": quality.cleaning_log(raw, loaded, settings),
        "feature_descriptive_stats": reports.descriptive_stats(panel, settings),
        "feature_correlation_matrix": reports.correlation_matrix(panel, settings),
        "sql_summary": reports.sql_summary(
            {
                "raw_prices": loaded["prices"],
                "raw_controversies": loaded["controversies"],
                "model_dataset": dataset,
                "stock_scores": reports.with_sector(scores, panel),
            }
        ),
        **text_tables(spark, news, weekly, dataset, settings),
    }
    # a quarter needs a date to score at and `settings.horizon` dates after it
    if panel.select("date").distinct().count() > settings.horizon:
        quarter = portfolio.quarter_backtest(scored, features=settings.features)
        tables["quarter_backtest_returns"] = quarter["weekly"]
        tables["quarter_excluded_stocks"] = quarter["excluded"]
        tables["quarter_backtest_summary"] = quarter["summary"]
    return RunResult(panel, dataset, trained, tables)


def business_rows(overlay: DataFrame) -> DataFrame:
    """(metric, value) rows, or one error row for fewer than eight weeks."""
    rows = sinks.to_metric_rows(portfolio.business_summary(overlay))
    short = overlay.agg(F.count("*").alias("n")).where("n < 8").select(
        F.lit("error").alias("metric"), F.lit("not enough evaluation weeks for business analysis").alias("value")
    )
    return rows.unionByName(short)


def text_tables(
    spark: SparkSession,
    news: loaders.TextInput,
    weekly: DataFrame | None,
    dataset: DataFrame,
    settings: Settings,
) -> dict[str, DataFrame]:
    if news.texts is None:
        status = news.status_row(spark)
        topics = text.empty_topics(spark, news.status, news.source_file)
        return {
            "textual_analysis": status,
            "textual_ticker_summary": status,
            "text_coverage": text.empty_coverage(dataset, news.status, news.source_file),
            "lda_topic_words": topics["topic_words"],
            "lda_ticker_topics": topics["ticker_topics"],
            "textual_bigram_terms": spark.createDataFrame(
                [], "sentiment_bucket string, bigram string, tfidf_weight double"
            ),
        }
    numbered = text.with_text_id(news.texts)
    topics = text.topics(numbered, news.source_file, seed=settings.seed)
    return {
        "textual_analysis": weekly,
        "textual_ticker_summary": text.ordered_ticker_summary(weekly),
        "text_coverage": text.text_coverage(weekly, dataset, settings),
        "lda_topic_words": topics["topic_words"],
        "lda_ticker_topics": topics["ticker_topics"],
        "textual_bigram_terms": text.bigram_terms(numbered),
    }


def write(result: RunResult, processed: str, outputs: str, json_folder: str | None = None) -> None:
    """Panel and dataset as parquet by year, every table as CSV, and as JSON records if asked."""
    sinks.write_parquet_by_year(result.panel, f"{processed}/feature_panel.parquet")
    sinks.write_parquet_by_year(result.dataset, f"{processed}/model_dataset.parquet")
    for name, table in result.tables.items():
        sinks.write_csv(table.orderBy(*ORDERED[name]) if name in ORDERED else table, f"{outputs}/{name}.csv", single_file=name in SHORT)
    if json_folder:
        sinks.write_payload(payload(result), json_folder)


def payload(result: RunResult) -> dict[str, DataFrame]:
    metadata = result.tables["stock_scores"].agg(
        F.count("*").alias("score_count"), F.count_distinct("ticker").alias("ticker_count")
    )
    return {"metadata": metadata, **result.tables}


def main(arguments: list[str]) -> None:
    """spark-submit entry: input folder, processed folder, output folder, [--tune]."""
    folders = [a for a in arguments if not a.startswith("--")]
    spark = build_session("tailspark-run")
    result = run(
        spark,
        loaders.discover_sources(spark, folders[0]),
        loaders.discover_text(spark, folders[0]),
        tune="--tune" in arguments,
    )
    write(result, folders[1], folders[2])


if __name__ == "__main__":
    main(sys.argv[1:])

"""Small report tables over the panel, the scores and the model outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.config import Settings, feature_group
from tailspark.operators.ranking import with_position


def descriptive_stats(panel: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per feature from a single aggregation of the panel."""
    features = (settings or Settings()).features
    aggregates = [F.count("*").alias("_rows")]
    for f in features:
        x = F.col(f).cast("double") if f in panel.columns else F.lit(None).cast("double")
        aggregates += [
            F.count(x).alias(f"{f}_n"),
            F.avg(x).alias(f"{f}_mean"),
            F.stddev_samp(x).alias(f"{f}_std"),
            F.min(x).alias(f"{f}_min"),
            F.max(x).alias(f"{f}_max"),
        ]
    blank = F.col("_rows") - F.lit(0)
    lines = [
        F.struct(
            F.lit(f).alias("feature"),
            F.lit(feature_group(f)).alias("feature_group"),
            F.col(f"{f}_n").alias("count"),
            *[F.col(f"{f}_{m}").alias(m) for m in ("mean", "std", "min", "max")],
            (blank - F.col(f"{f}_n")).alias("null_count"),
            F.round((blank - F.col(f"{f}_n")) / F.nullif("_rows", F.lit(0)) * 100.0, 4).alias("null_percent"),
        )
        for f in features
    ]
    return panel.agg(*aggregates).select(F.inline(F.array(*lines)))


PAIR_SCHEMA = "i int, j int, n double, xy double, x double, y double, xx double, yy double"


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the rows where both of a pair are known, for every pair, once per task.

    Missing values count as zero and a mask says where they were, so each sum over pairs is
    one matrix product per batch.
    """
    total = None
    for batch in batches:
        z = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        known = (~np.isnan(z)).astype(float)
        z = np.nan_to_num(z)
        sums = np.stack([known.T @ known, z.T @ z, z.T @ known, known.T @ z, (z * z).T @ known, known.T @ (z * z)])
        total = sums if total is None else total + sums
    if total is not None:
        i, j = np.triu_indices(total.shape[1])
        columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j]) for m in total]]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "n", "xy", "x", "y", "xx", "yy"])


def correlation_matrix(panel: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations, null where one side does not vary.

    Values are centred and scaled by a first pass, then a second pass sums up all pairs with
    matrix products inside the tasks; only one row per task and pair is shuffled.
    """
    features = (settings or Settings()).features
    values = {
        f: F.col(f).cast("double") if f in panel.columns else F.lit(None).cast("double") for f in features
    }
    scale = panel.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(values.values())],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(values.values())],
    ).first()
    centred = panel.select(
        *[
            ((x - F.lit(scale[f"m{i}"] or 0.0)) / F.lit(scale[f"s{i}"] or 1.0)).alias(f)
            for i, (f, x) in enumerate(values.items())
        ]
    )
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = (F.col("xx") - x * x / n) * (F.col("yy") - y * y / n)
    # what rounding leaves of a constant counts as no spread
    pairs = (
        centred.mapInArrow(_pair_moments, PAIR_SCHEMA)
        .groupBy("i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "xy", "x", "y", "xx", "yy")])
        .where(F.col("n") > 1)
        .select("i", "j", F.when(spread > 1e-18 * n * n, (F.col("xy") - x * y / n) / F.sqrt(spread)).alias("r"))
    )
    both = pairs.unionByName(pairs.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    rows = both.groupBy("i").agg(
        *[F.max(F.when(F.col("j") == k, F.col("r"))).alias(f) for k, f in enumerate(features)]
    )
    names = panel.sparkSession.createDataFrame(list(enumerate(features)), "i int, feature string")
    return names.join(rows, "i", "left").select("feature", *features)


def sector_controversy(panel: DataFrame, top: int = 10) -> DataFrame:
    return (
        panel.where(F.col("sector").isNotNull() & F.col("controversy_score").isNotNull())
        .groupBy("sector")
        .agg(F.avg("controversy_score").alias("controversy_score"))
        .orderBy(F.col("controversy_score").desc(), "sector")
        .limit(top)
    )


def controversy_over_time(panel: DataFrame) -> DataFrame:
    return (
        panel.where(F.col("controversy_score").isNotNull())
        .groupBy("date")
        .agg(F.avg("controversy_score").alias("controversy_score"))
    )


def price_history(panel: DataFrame, max_weeks: int = 104) -> DataFrame:
    """The newest rows of each ticker (a ticker has one row a week)."""
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return (
        panel.select("ticker", "date", "adj_close", newest.alias("_place"))
        .where(F.col("_place") <= max_weeks)
        .drop("_place")
    )


def recent_prices(history: DataFrame, ticker: str, n: int = 52) -> DataFrame:
    """The newest `n` positive prices of one ticker."""
    return (
        history.where((F.col("ticker") == ticker) & (F.col("adj_close") > 0))
        .select("ticker", "date", "adj_close")
        .orderBy(F.col("date").desc())
        .limit(n)
    )


def latest_rows(panel: DataFrame, columns: list[str]) -> DataFrame:
    """The newest row of each ticker.

    The newest dates come from a hash aggregation; the struct, which would sort all rows, is only formed of the rows of
    those dates. `panel` is stored: it is read twice.
    """
    newest = panel.groupBy("ticker").agg(F.max("date").alias("date"))
    tied = panel.select("ticker", "date", *columns).join(newest, ["ticker", "date"], "left_semi")
    return tied.groupBy("ticker").agg(F.max(F.struct("date", *columns)).alias("m")).select("ticker", "m.*")


def price_scenarios(panel: DataFrame, scores: DataFrame, horizon: int = 13, z: float = 1.645) -> DataFrame:
    """Price range at the horizon from realised volatility; crash probability widens the low end.

    `scores` must hold a ticker once.
    """
    if not scores.groupBy("ticker").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("scores must have one row for each ticker")
    latest = latest_rows(panel, ["adj_close", "realized_volatility"]).drop("date")
    price = F.col("adj_close")
    p = F.coalesce("crash_probability", F.lit(0.0))
    vol = (
        F.greatest(F.coalesce("realized_volatility", F.lit(0.0)), F.lit(0.0))
        / F.sqrt(F.lit(52.0))
        * F.sqrt(F.lit(float(horizon)))
    )
    widened = 1.0 + F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return scores.join(latest, "ticker", "left").select(
        "ticker",
        "as_of_date",
        price.alias("latest_price"),
        F.lit(horizon).alias("horizon_weeks"),
        (price * F.exp(-z * vol * widened)).alias("price_p05"),
        price.alias("price_p50"),
        (price * F.exp(z * vol)).alias("price_p95"),
        p.alias("crash_probability"),
        "risk_bucket",
        F.lit("historical_volatility_crash_adjusted").alias("scenario_method"),
    )


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    """The `n` heaviest features of an importance table, ties by name."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(n)


def representative_tickers(scores: DataFrame) -> DataFrame:
    """Two riskiest High and two safest Low names, filled up to four by probability."""
    p = F.col("crash_probability")

    def pick(rows: DataFrame, order: Column, n: int, tier: int) -> DataFrame:
        return rows.orderBy(order, "ticker").limit(n).select(
            "ticker", F.struct(F.lit(tier).alias("tier"), (p if tier == 1 else -p).alias("p"), "ticker").alias("rank")
        )

    chosen = (
        pick(scores.where("risk_bucket = 'High'"), p.desc(), 2, 0)
        .unionByName(pick(scores.where("risk_bucket = 'Low'"), p.asc(), 2, 1))
        .unionByName(pick(scores, p.desc(), 4, 2))
    )
    return (
        chosen.groupBy("ticker")
        .agg(F.min("rank").alias("rank"))
        .orderBy("rank")
        .limit(4)
        .select("ticker", F.col("rank.tier").alias("tier"))
    )


def representative_prices(panel: DataFrame, scores: DataFrame) -> DataFrame:
    """Price rows of the four representative tickers (a four-row broadcast)."""
    chosen = F.broadcast(representative_tickers(scores).select("ticker"))
    return panel.where(F.col("adj_close").isNotNull()).join(chosen, "ticker", "left_semi").select(
        "ticker", "date", "adj_close"
    )


def high_risk_history(panel: DataFrame, scores: DataFrame, names: int = 5) -> DataFrame:
    """Score history of the first High names by probability."""
    first = (
        scores.where("risk_bucket = 'High'")
        .orderBy(F.col("crash_probability").desc(), "ticker")
        .limit(names)
        .select("ticker")
    )
    return panel.join(F.broadcast(first), "ticker", "left_semi").select("ticker", "date", "controversy_score")


def top_scores(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.col("crash_probability").desc(), "ticker").limit(n)


def ranked_scores(scores: DataFrame) -> DataFrame:
    """Score table with its place, riskiest first, for universes of any size."""
    return with_position(scores, [], [F.col("crash_probability").desc(), F.col("ticker").asc()], "place")


def filtered_scores(scores: DataFrame, bucket: str = "All", search: str = "") -> DataFrame:
    """Bucket names in any case; part of a ticker."""
    name = F.lower(F.trim("risk_bucket"))
    rows = scores.withColumn(
        "risk_bucket", F.when(name == "high", "High").when(name == "medium", "Medium").otherwise("Low")
    )
    if bucket != "All":
        rows = rows.where(F.col("risk_bucket") == bucket)
    return rows.where(F.col("ticker").contains(search.strip().upper())) if search.strip() else rows


def score_kpis(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("names"),
        F.count_if(F.col("risk_bucket") == "High").alias("high_names"),
        F.coalesce(F.avg("crash_probability"), F.lit(0.0)).alias("average_probability"),
        F.max("as_of_date").alias("as_of_date"),
    )


def text_kpis(weekly: DataFrame) -> DataFrame:
    return weekly.agg(
        F.sum("article_count").alias("articles"),
        F.avg("text_sentiment_score").alias("average_sentiment"),
        F.sum("negative_word_count").alias("negative_words"),
        F.sum("positive_word_count").alias("positive_words"),
        F.sum("controversy_keyword_count").alias("controversy_keywords"),
        F.count_distinct("ticker").alias("tickers"),
    )


def importance_percents(importance: DataFrame, top: int = 15) -> DataFrame:
    """Whole percents that add up to 100: floors, then one point each to the largest fractions.

    At most `top` rows are ranked.
    """
    rows = importance.orderBy(F.col("importance").desc(), "feature").limit(top)
    whole = Window.partitionBy()
    share = (
        F.greatest("importance", F.lit(0.0))
        / F.coalesce(F.nullif(F.sum(F.greatest("importance", F.lit(0.0))).over(whole), F.lit(0.0)), F.lit(1.0))
        * 100.0
    )
    base = rows.withColumn("share_percent", share).withColumn("_floor", F.floor("share_percent"))
    by_fraction = Window.orderBy(
        (F.col("share_percent") - F.col("_floor")).desc(), F.col("importance").desc(), "feature"
    )
    return base.select(
        "feature",
        "importance",
        "share_percent",
        (
            F.col("_floor")
            + (F.row_number().over(by_fraction) <= 100 - F.sum("_floor").over(whole)).cast("int")
        ).alias("percent"),
    )


def excluded_with_return(excluded: DataFrame) -> DataFrame:
    return excluded.where(F.col("quarter_return").isNotNull()).orderBy("quarter_return", "ticker")


@dataclass(frozen=True)
class Summary:
    """A grouped or plain report on one table. Keys and figures are expressions by output name;
    without figures the rows themselves are shown."""

    table: str
    keys: dict[str, str]
    figures: dict[str, str] = field(default_factory=dict)
    only: str | None = None
    order: tuple[str, ...] = ()  # output names; a leading minus sorts downwards
    first: int | None = None

    def build(self, df: DataFrame) -> DataFrame:
        rows = df.where(self.only) if self.only else df
        keys = [F.expr(e).alias(n) for n, e in self.keys.items()]
        figures = [F.expr(e).alias(n) for n, e in self.figures.items()]
        out = rows.groupBy(*keys).agg(*figures) if figures else rows.select(*keys)
        if self.order:
            out = out.orderBy(*[F.col(o[1:]).desc() if o[0] == "-" else F.col(o).asc() for o in self.order])
        return out.limit(self.first) if self.first else out

    def describe(self) -> str:
        """What the report does, for readers of the summary table."""
        shown = ", ".join(n if n == e else f"{n} = {e}" for n, e in {**self.keys, **self.figures}.items())
        parts = [f"{self.table}: {shown}"]
        if self.only:
            parts.append(f"where {self.only}")
        if self.figures and self.keys:
            parts.append(f"for each {', '.join(self.keys)}")
        if self.order:
            parts.append("by " + ", ".join(f"{o[1:]} falling" if o[0] == "-" else o for o in self.order))
        if self.first:
            parts.append(f"first {self.first}")
        return "; ".join(parts)


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def _missing(*names: str) -> dict[str, str]:
    return {f"missing_{n}": f"count_if({n} is null)" for n in names}


# Report and column names are those of the method's result tables.
SUMMARIES = {
    "observations_by_ticker": Summary(
        "raw_prices", _same("ticker"),
        {"observations": "count(1)", "start_date": "min(date)", "end_date": "max(date)"},
        order=("-observations", "ticker"), first=20,
    ),
    "sector_controversy_summary": Summary(
        "raw_controversies", _same("sector"),
        {"tickers": "count(distinct ticker)", "records": "count(1)", "avg_controversy_score": "avg(controversy_score)"},
        order=("-avg_controversy_score",),
    ),
    "top_controversy_events": Summary(
        "raw_controversies", _same("ticker", "date", "sector", "controversy_score"),
        order=("-controversy_score", "ticker", "date"), first=10,
    ),
    "target_class_balance": Summary(
        "model_dataset", _same("high_crash_risk"), {"rows": "count(1)"}, order=("-high_crash_risk",)
    ),
    "high_risk_names_by_sector": Summary(
        "stock_scores", {"sector": "coalesce(sector, 'Unknown')"},
        {"high_risk_names": "count(1)", "avg_crash_probability": "avg(crash_probability)"},
        only="risk_bucket = 'High'", order=("-high_risk_names", "-avg_crash_probability"),
    ),
    "model_feature_missingness": Summary(
        "model_dataset", {},
        {"rows": "count(1)", **_missing("lagged_ncskew", "downside_beta", "controversy_score", "market_cap")},
    ),
}


def summary_query(name: str, views: dict[str, DataFrame]) -> DataFrame:
    """One of the summary reports over the given tables."""
    return SUMMARIES[name].build(views[SUMMARIES[name].table])


def with_sector(scores: DataFrame, panel: DataFrame) -> DataFrame:
    """Scores with the newest known sector of their ticker."""
    if "sector" in scores.columns:
        return scores
    newest = latest_rows(panel.where(F.col("sector").isNotNull()), ["sector"]).drop("date")
    return scores.join(newest, "ticker", "left")


def sql_summary(views: dict[str, DataFrame]) -> DataFrame:
    """(query_name, query, result_json, row_count); every result is a short report."""
    out = None
    for name, summary in SUMMARIES.items():
        result = summary_query(name, views)
        row = result.agg(
            F.to_json(F.collect_list(F.struct(*result.columns)), {"ignoreNullFields": "false"}).alias("result_json"),
            F.count("*").alias("row_count"),
        ).select(F.lit(name).alias("query_name"), F.lit(summary.describe()).alias("query"), "result_json", "row_count")
        out = row if out is None else out.unionByName(row)
    return out

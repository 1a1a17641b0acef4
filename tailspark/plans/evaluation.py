"""Model evaluation tables over scored rows (keys, date, ticker, label, crash_probability).

Groups here are whole splits, so every rank goes over range slices instead of one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.operators.ranking import running_totals, with_position_and_size

LABEL, PROBABILITY = "high_crash_risk", "crash_probability"

METRICS = ("roc_auc", "precision_at_top_bucket", "crash_capture_at_top_bucket")


def roc_auc(scored: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, roc_auc): exact rank-sum area with ties averaged; null for a single class. `weight` counts equal rows."""
    label, n = F.col(LABEL), F.lit(1) if weight is None else F.col(weight)
    counts = scored.groupBy(*keys, PROBABILITY).agg(
        F.sum(label * n).alias("_pos"), F.sum((1 - label) * n).alias("_neg")
    )
    ranked = running_totals(counts, keys, [F.col(PROBABILITY).asc()], {"_neg_below": F.col("_neg")})
    pos = F.col("_pos").cast("double")
    totals = ranked.groupBy(*keys).agg(
        F.sum(pos * (F.col("_neg_below") + F.col("_neg") / 2)).alias("_wins"),
        F.sum(pos).alias("_p"),
        F.sum(F.col("_neg").cast("double")).alias("_n"),
    )
    return totals.select(
        *keys, (F.col("_wins") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("roc_auc")
    )


def flagged(scored: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Add `in_top`, the ceil(share * n) most probable rows of each group; ties by date, ticker."""
    order = [F.col(PROBABILITY).desc(), F.col("date").asc(), F.col("ticker").asc()]
    ranked = with_position_and_size(scored, keys, order, "_position", "_size")
    top = F.greatest(F.lit(1), F.ceil(F.col("_size") * F.lit(float(share))))
    return ranked.withColumn("in_top", F.col("_position") <= top).drop("_position", "_size")


def top_bucket(scored: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    label = F.col(LABEL)
    captured = F.sum(F.when(F.col("in_top"), label).otherwise(0))
    size = F.count_if(F.col("in_top"))
    return (
        flagged(scored, keys, share)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_rows"),
            F.sum(label).alias("n_positive"),
            size.alias("top_bucket_size"),
            (captured / F.nullif(size, F.lit(0))).alias("precision_at_top_bucket"),
            (captured / F.nullif(F.sum(label), F.lit(0))).alias("crash_capture_at_top_bucket"),
        )
    )


def evaluate(scored: DataFrame, keys: Sequence[str] = ("model", "split"), share: float = 0.20) -> DataFrame:
    """One row per group: sizes, exact AUC, precision and capture of the top share."""
    return top_bucket(scored, keys, share).join(roc_auc(scored, keys), list(keys))


def delta_rows(report: DataFrame, base: str, other: str, name: str, carried: Sequence[str] = ()) -> DataFrame:
    """other minus base per split, as rows of a model called `name`."""
    a = report.where(F.col("model") == base).alias("a")
    b = report.where(F.col("model") == other).alias("b")
    return a.join(b, F.col("a.split") == F.col("b.split")).select(
        F.lit(name).alias("model"),
        F.col("b.split").alias("split"),
        *[F.col(f"b.{c}").alias(c) for c in ("n_rows", "n_positive", "top_bucket_size", *carried)],
        (F.col("b.feature_count") - F.col("a.feature_count")).alias("feature_count"),
        *[(F.col(f"b.{m}") - F.col(f"a.{m}")).alias(m) for m in METRICS],
    )


def with_deltas(report: DataFrame, base: str, other: str, name: str, carried: Sequence[str] = ()) -> DataFrame:
    columns = [
        "model",
        "split",
        "n_rows",
        "n_positive",
        "feature_count",
        "top_bucket_size",
        *carried,
        *METRICS,
    ]
    return report.select(*columns).unionByName(
        delta_rows(report, base, other, name, carried).select(*columns)
    )


def class_metrics(scored: DataFrame, keys: Sequence[str] = ("split",), threshold: float = 0.5) -> DataFrame:
    """AUC, precision, recall and F1 at a probability threshold; an empty ratio is 0."""
    tp, fp, _, fn = _outcomes(F.col(PROBABILITY) >= threshold)
    counts = scored.groupBy(*keys).agg(tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"))
    hit, false_alarm, miss = F.col("_tp"), F.col("_fp"), F.col("_fn")

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))

    return counts.join(roc_auc(scored, keys), list(keys)).select(
        *keys,
        "roc_auc",
        ratio(hit, hit + false_alarm).alias("precision"),
        ratio(hit, hit + miss).alias("recall"),
        ratio(2 * hit, 2 * hit + false_alarm + miss).alias("f1"),
    )


def _outcomes(predicted: Column) -> tuple[Column, Column, Column, Column]:
    crash = F.col(LABEL) == 1
    return (
        F.count_if(crash & predicted),
        F.count_if(~crash & predicted),
        F.count_if(~crash & ~predicted),
        F.count_if(crash & ~predicted),
    )


def confusion(scored: DataFrame, split: str = "test", share: float = 0.20) -> DataFrame:
    """Two rows: the 0.5 threshold and the top share by rank."""
    rows = flagged(scored.where(F.col("split") == split), ["split"], share)
    predictions = F.array(
        F.struct(
            F.lit("probability_0_50").alias("threshold"),
            F.lit(0.5).alias("threshold_value"),
            (F.col(PROBABILITY) >= 0.5).alias("predicted"),
        ),
        F.struct(
            F.lit(f"top_{round(share * 100)}_percent").alias("threshold"),
            F.lit(float(share)).alias("threshold_value"),
            F.col("in_top").alias("predicted"),
        ),
    )
    outcomes = rows.select("split", LABEL, F.inline(predictions))
    counts = outcomes.groupBy("split", "threshold", "threshold_value").agg(
        F.count("*").alias("n_rows"),
        *[c.alias(n) for c, n in zip(_outcomes(F.col("predicted")), ("tp", "fp", "tn", "fn"))],
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def ratio(top: Column, bottom: Column) -> Column:
        return top / F.nullif(bottom, F.lit(0))

    return counts.select(
        "*",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
        ratio(fn, fn + tp).alias("false_negative_rate"),
        ratio(tp + tn, F.col("n_rows")).alias("accuracy"),
    )


def calibration(scored: DataFrame, split: str = "test", n_bins: int = 5) -> DataFrame:
    """Fixed probability bins, the last one closed; a bin without rows stays, with nulls."""
    edges = [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]
    p = F.col(PROBABILITY)
    number = F.when(p < 0.0, None)
    for i in range(1, n_bins):
        number = number.when(p < edges[i], i)
    number = number.when(p <= 1.0, n_bins)
    filled = (
        scored.where(F.col("split") == split)
        .groupBy(number.alias("bin"))
        .agg(
            F.count("*").alias("n_rows"),
            F.avg(p).alias("mean_predicted_probability"),
            F.avg(F.col(LABEL)).alias("observed_crash_rate"),
        )
    )
    bins = scored.sparkSession.createDataFrame(
        [(split, i + 1, edges[i], edges[i + 1]) for i in range(n_bins)],
        "split string, bin int, probability_min double, probability_max double",
    )
    return F.broadcast(bins).join(filled, "bin", "left").select(
        "split",
        "bin",
        "probability_min",
        "probability_max",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "mean_predicted_probability",
        "observed_crash_rate",
    )


def best_test_auc(report: DataFrame) -> DataFrame:
    return report.where(F.col("split") == "test").agg(F.max("roc_auc").alias("best_test_roc_auc"))


def class_balance(dataset: DataFrame) -> DataFrame:
    return dataset.where(F.col(LABEL).isNotNull()).groupBy(LABEL).agg(F.count("*").alias("rows"))

"""Train, tune, compare and apply the crash classifiers with Spark ML.

Preparation (exact median, population standardisation) is fitted as one row of statistics
and applied as plain column expressions, so scoring a panel is a single narrow pass.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from statistics import fmean, pstdev
from typing import Any

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.config import TEXT_SIGNALS, Settings, require_columns
from tailspark.operators import forest, newton
from tailspark.operators.calendar import chronological_split
from tailspark.operators.ranking import with_position, with_risk_bucket
from tailspark.operators.selection import exact_medians
from tailspark.plans import evaluation, search
from tailspark.staging import stage

LABEL = evaluation.LABEL
MODEL_TYPES = ("logistic_regression", "random_forest", "gradient_boosting")

# Fixed values of the method: the searched grids, under their published names.
GRIDS: dict[str, dict[str, list]] = {
    "logistic_regression": {
        "classifier__C": [0.01, 0.1, 1.0, 10.0],
        "classifier__penalty": ["l2"],
    },
    "random_forest": {
        "classifier__n_estimators": [100],
        "classifier__max_depth": [3, 5, 8],
        "classifier__min_samples_leaf": [5, 10],
    },
    "gradient_boosting": {
        "classifier__n_estimators": [100],
        "classifier__max_depth": [2, 3],
        "classifier__learning_rate": [0.05, 0.10],
    },
}
# Defaults outside a search. A forest's depth is unlimited in the method; 30 is the most that Spark's
# forests take. Split points of a feature come from `classifier__max_bins` quantile bins (Spark's
# trees have no exact splits); raise it for finer ones.
DEFAULTS = {
    "logistic_regression": {"classifier__C": 1.0},
    "random_forest": {
        "classifier__n_estimators": 100,
        "classifier__max_depth": 30,
        "classifier__min_samples_leaf": 1,
        "classifier__max_bins": 32,
    },
    "gradient_boosting": {
        "classifier__n_estimators": 100,
        "classifier__max_depth": 3,
        "classifier__learning_rate": 0.1,
        "classifier__max_bins": 32,
    },
}
# Spark's forest passes over all rows per batch of nodes: right for the few nodes of a shallow tree only.
SHALLOW = 12


@dataclass(frozen=True)
class Preparation:
    """One row of fitted statistics: median, mean and scale per feature."""

    features: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def columns(self) -> list[Column]:
        return [
            (F.coalesce(F.col(f).cast("double"), F.lit(m)) - F.lit(mu)) / F.lit(s)
            for f, m, mu, s in zip(self.features, self.median, self.mean, self.scale)
        ]


def fit_preparation(train: DataFrame, features: Sequence[str]) -> Preparation:
    """Exact medians (0 for an empty column), then mean and population deviation of the filled values."""
    found = exact_medians(train, features)
    median = tuple(0.0 if found[f] is None else float(found[f]) for f in features)
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(features, median)]
    row = train.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)],
    ).first()
    return Preparation(
        tuple(features),
        median,
        tuple(row[f"m{i}"] for i in range(len(features))),
        tuple(row[f"s{i}"] or 1.0 for i in range(len(features))),
    )


@dataclass(frozen=True)
class FittedModel:
    model_type: str
    preparation: Preparation
    classifier: Any
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def features(self) -> tuple[str, ...]:
        return self.preparation.features

    def predict(self, df: DataFrame, name: str = "crash_probability") -> DataFrame:
        """Add the probability of class 1 to every row."""
        require_columns(df.columns, self.features, "panel")
        if isinstance(self.classifier, newton.LogisticFit):
            return df.select(*df.columns, self.classifier.probability(self.preparation.columns()).alias(name))
        scored = self.classifier.transform(
            df.withColumn("_vector", array_to_vector(F.array(*self.preparation.columns())))
        )
        return scored.select(*df.columns, vector_to_array("_probability")[1].alias(name))

    def importances(self) -> list[tuple[str, float]]:
        if self.model_type == "logistic_regression":
            values = [abs(c) for c in self.classifier.coefficients.toArray()]
        else:
            values = self.classifier.featureImportances.toArray()
        return sorted(zip(self.features, map(float, values)), key=lambda item: -item[1])

    def top_drivers(self, n: int = 3) -> Column:
        """Features with the largest contributions to the row's score, `;`-joined."""
        if self.model_type != "logistic_regression":
            return F.lit("")
        parts = [
            F.struct(F.abs(x * F.lit(float(c))).alias("size"), F.lit(i).alias("place"), F.lit(f).alias("name"))
            for i, (f, x, c) in enumerate(
                zip(self.features, self.preparation.columns(), self.classifier.coefficients.toArray())
            )
        ]
        largest = F.slice(F.sort_array(F.array(*parts), asc=False), 1, n)
        return F.array_join(F.transform(largest, lambda part: part["name"]), ";")


def _balanced(counts: dict[int, int]) -> tuple[float, float]:
    """The weight of a row of each class that gives both classes an equal total."""
    rows = sum(counts.values())
    return rows / (2.0 * counts[0]), rows / (2.0 * counts[1])


def _logistic_task(scaled: int, counts: dict[int, int], c: float) -> newton.Task:
    # sum(C * w * loss) + |b|^2 / 2 divided by C * sum(w); balanced weights add up to the rows
    rows = sum(counts.values())
    return newton.Task(scaled, _balanced(counts), 1.0 / (c * rows), rows)


def _scaled(preparation: Preparation, last: int = 0) -> newton.Scaled:
    return newton.Scaled(preparation.median, preparation.mean, preparation.scale, last)


def _classifier(model_type: str, params: dict[str, Any], seed: int, rows: int):
    names = {"featuresCol": "_vector", "labelCol": LABEL}
    if model_type == "random_forest":
        return RandomForestClassifier(
            **names,
            probabilityCol="_probability",
            weightCol="_weight",
            numTrees=params["classifier__n_estimators"],
            maxDepth=params["classifier__max_depth"],
            minInstancesPerNode=params["classifier__min_samples_leaf"],
            maxBins=params["classifier__max_bins"],
            featureSubsetStrategy="sqrt",
            seed=seed,
        )
    return GBTClassifier(
        **names,
        maxIter=params["classifier__n_estimators"],
        maxDepth=params["classifier__max_depth"],
        stepSize=params["classifier__learning_rate"],
        maxBins=params["classifier__max_bins"],
        # the ensemble's lineage is cut at the session's checkpoint folder
        checkpointInterval=10,
        seed=seed,
    ).setProbabilityCol("_probability")


def fit(
    train: DataFrame,
    features: Sequence[str],
    model_type: str = "logistic_regression",
    params: dict[str, Any] | None = None,
    seed: int = 42,
) -> FittedModel:
    """Prepare and fit on stored labelled rows, classes weighted to equal total."""
    if model_type not in MODEL_TYPES:
        raise ValueError(f"Unknown model type {model_type}")
    chosen = {**DEFAULTS[model_type], **(params or {})}
    counts = {r[LABEL]: r.n for r in train.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        raise ValueError("Need at least two target classes to train")
    rows = sum(counts.values())
    preparation = fit_preparation(train, features)
    if model_type == "logistic_regression":
        task = _logistic_task(0, counts, chosen["classifier__C"])
        found = newton.fit_logistic(train, LABEL, features, [_scaled(preparation)], [task])
        return FittedModel(model_type, preparation, found[0], chosen)
    if model_type == "random_forest" and chosen["classifier__max_depth"] > SHALLOW:
        deep = forest.fit_forest(
            train,
            LABEL,
            preparation.columns(),
            (rows / (2.0 * counts[0]), rows / (2.0 * counts[1])),
            chosen["classifier__n_estimators"],
            chosen["classifier__max_depth"],
            chosen["classifier__min_samples_leaf"],
            chosen["classifier__max_bins"],
            seed,
        )
        return FittedModel(model_type, preparation, deep, chosen)
    weighted = train.select(
        F.col(LABEL).cast("double").alias(LABEL),
        F.when(F.col(LABEL) == 1, rows / (2.0 * counts[1])).otherwise(rows / (2.0 * counts[0])).alias("_weight"),
        array_to_vector(F.array(*preparation.columns())).alias("_vector"),
    )
    classifier = _classifier(model_type, chosen, seed, rows).fit(weighted)
    return FittedModel(model_type, preparation, classifier, chosen)


def optimality(model: FittedModel, train: DataFrame) -> DataFrame:
    """(term, coefficient, gradient) of a logistic fit: the gradient of its penalised objective, by one aggregation.

    The objective is strictly convex, so a gradient of zero marks the one optimum, whatever way the fit took. The
    loss is the mean over the rows, classes weighted to equal total; the intercept bears no penalty.
    """
    if model.model_type != "logistic_regression":
        raise ValueError("Only a logistic fit has a gradient")
    counts = {r[LABEL]: r.n for r in train.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    label = F.col(LABEL).cast("double")
    weight = F.when(F.col(LABEL) == 1, rows / (2.0 * counts[1])).otherwise(rows / (2.0 * counts[0]))
    coefficients = [float(c) for c in model.classifier.coefficients.toArray()]
    intercept = float(model.classifier.intercept)
    xs = [F.col(f"_x{i}") for i in range(len(coefficients))]
    prepared = train.select(
        label.alias("_y"), weight.alias("_w"), *[x.alias(f"_x{i}") for i, x in enumerate(model.preparation.columns())]
    )
    score = sum((x * F.lit(c) for x, c in zip(xs, coefficients)), F.lit(intercept))
    residual = prepared.withColumn("_r", F.col("_w") * (1.0 / (1.0 + F.exp(-score)) - F.col("_y")))
    sums = residual.agg(F.avg("_r").alias("g"), *[F.avg(F.col("_r") * x).alias(f"g{i}") for i, x in enumerate(xs)])
    penalty = 1.0 / (model.params["classifier__C"] * rows)
    terms = [("intercept", intercept, F.col("g"))]
    terms += [(f, c, F.col(f"g{i}") + F.lit(penalty * c)) for i, (f, c) in enumerate(zip(model.features, coefficients))]
    lines = [F.struct(F.lit(t).alias("term"), F.lit(c).alias("coefficient"), g.alias("gradient")) for t, c, g in terms]
    return sums.select(F.inline(F.array(*lines)))


def labelled_rows(
    dataset: DataFrame, settings: Settings, extra: Sequence[str] = (), purpose: str = "train"
) -> DataFrame:
    """Labelled rows with their split, cut to the needed columns and stored."""
    require_columns(dataset.columns, (*settings.features, *extra, LABEL, "date"), "model dataset")
    rows = dataset.where(F.col(LABEL).isNotNull()).select(
        "ticker",
        "date",
        F.col(LABEL).cast("int").alias(LABEL),
        *[F.col(f).cast("double").alias(f) for f in (*settings.features, *extra)],
    )
    stored = stage(rows, "labelled")
    if stored.agg(F.count_distinct(LABEL).alias("n")).first().n < 2:
        raise ValueError(f"Need at least two target classes to {purpose}")
    return chronological_split(stored, settings.train_fraction, settings.validation_fraction)


def train_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split") == "train")


def held_out(model: FittedModel, rows: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Scored validation and test rows, narrow enough to rank."""
    return model.predict(rows.where(F.col("split") != "train")).select(
        F.lit(name).alias("model"), "split", "date", "ticker", LABEL, "crash_probability", *keep
    )


@dataclass(frozen=True)
class CrossValidation:
    best_params: dict[str, Any]
    mean_auc: float
    std_auc: float
    folds: int
    candidates: int


def grid(model_type: str) -> list[dict[str, Any]]:
    names = list(GRIDS[model_type])
    return [dict(zip(names, values)) for values in product(*GRIDS[model_type].values())]


def cross_validate(
    train: DataFrame,
    features: Sequence[str],
    model_type: str,
    folds: int = 5,
    seed: int = 42,
    candidates: list[dict[str, Any]] | None = None,
    parallelism: int = 4,
) -> CrossValidation:
    """Expanding-window search: fold i trains on all rows before its block, in (date, ticker) order.

    A fold whose training rows or block hold one class only has no score; a candidate's mean and
    deviation are over the folds that have one. Without any score at all the search fails.
    """
    candidates = candidates or grid(model_type)
    scores = search.areas(time_folds(train, features, folds), model_type, candidates, seed, parallelism)
    return _winner(candidates, scores, folds)


def time_folds(train: DataFrame, features: Sequence[str], folds: int) -> search.Folds:
    """The rows with the number of their block; what the learners share of them is worked out once."""
    # one position per training row: the whole split is one group
    ordered = stage(with_position(train, [], [F.col("date").asc(), F.col("ticker").asc()], "_row"), "folds")
    rows = ordered.count()
    block = rows // (folds + 1)
    if block == 0:
        raise ValueError(f"Cannot have number of folds={folds + 1} greater than the number of rows")
    # the rows left over belong to the first part
    first = rows - folds * block
    part = F.when(F.col("_row") <= first, 0).otherwise(F.floor((F.col("_row") - first - 1) / block).cast("int") + 1)
    return search.Folds(ordered.withColumn("_part", part), features, "_part", range(folds))


def _winner(candidates: list[dict[str, Any]], scores: list[list[float]], folds: int) -> CrossValidation:
    if not scores[0]:
        raise ValueError("No fold has both classes in its training rows and in its block")
    best = max(range(len(candidates)), key=lambda i: fmean(scores[i]))
    return CrossValidation(
        candidates[best], fmean(scores[best]), pstdev(scores[best]), folds, len(candidates)
    )


@dataclass(frozen=True)
class TrainedModel:
    model: FittedModel
    metrics: DataFrame | None
    cross_validation: CrossValidation | None
    trained_rows: int
    date_range: tuple[dt.date, dt.date]
    class_balance: dict[int, int]

    def importance_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.model.importances(), "feature string, importance double")


def train_classifier(
    dataset: DataFrame,
    settings: Settings | None = None,
    model_type: str | None = None,
    tune: bool = False,
    fit_on: str = "all",
) -> TrainedModel:
    """Evaluate on the later splits with a fit on the first, then fit on all labelled rows.

    `fit_on="train"` keeps the first fit as the result, for backtests that must not see
    their own weeks.
    """
    settings = settings or Settings()
    kind = model_type or settings.model_type
    rows = labelled_rows(dataset, settings)
    first = train_rows(rows)
    params, search, metrics, early = None, None, None, None
    if first.agg(F.count_distinct(LABEL).alias("n")).first().n >= 2:
        if tune:
            search = cross_validate(first, settings.features, kind, settings.cv_folds, settings.seed)
            params = search.best_params
        early = fit(first, settings.features, kind, params, settings.seed)
        metrics = evaluation.class_metrics(stage(held_out(early, rows, kind), "held_out")).where(
            F.col("roc_auc").isNotNull()
        )
    final = early if fit_on == "train" and early else fit(rows, settings.features, kind, params, settings.seed)
    facts = rows.groupBy(LABEL).agg(
        F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")
    ).collect()
    return TrainedModel(
        final,
        metrics,
        search,
        sum(r.n for r in facts),
        (min(r.a for r in facts), max(r.b for r in facts)),
        {r[LABEL]: r.n for r in sorted(facts, key=lambda r: r[LABEL])},
    )


def score_latest(
    model: FittedModel, panel: DataFrame, as_of: str | dt.date | None = None, top_n: int = 3
) -> DataFrame:
    """(ticker, as_of_date, crash_probability, risk_bucket, top_drivers) of the newest date up to `as_of`."""
    require_columns(panel.columns, model.features, "panel")
    eligible = panel if as_of is None else panel.where(F.col("date") <= F.lit(as_of).cast("date"))
    newest = eligible.agg(F.max("date").alias("d")).first().d
    if newest is None:
        raise ValueError(f"No panel rows exist on or before as_of_date={as_of}")
    rows = model.predict(panel.where(F.col("date") == F.lit(newest))).select(
        "ticker", "date", "crash_probability", model.top_drivers(top_n).alias("top_drivers")
    )
    return with_risk_bucket(rows, ["date"]).select(
        "ticker", F.col("date").cast("string").alias("as_of_date"), "crash_probability", "risk_bucket", "top_drivers"
    )


def score_panel(model: FittedModel, panel: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Every panel row with its probability, stored for the backtests; `keep` names the columns they read."""
    scored = model.predict(panel)
    return stage(scored if keep is None else scored.select(*keep, "crash_probability"), "scored_panel")


def _compare(
    rows: DataFrame, feature_sets: dict[str, Sequence[str]], settings: Settings, keep: Sequence[str] = ()
) -> DataFrame:
    scored = None
    for name, features in feature_sets.items():
        model = fit(train_rows(rows), features, settings.model_type, None, settings.seed)
        part = held_out(model, rows, name, keep)
        scored = part if scored is None else scored.unionByName(part)
    counts = F.when(F.lit(False), 0)
    for name, features in feature_sets.items():
        counts = counts.when(F.col("model") == name, len(features))
    scored = stage(scored, "compared")
    report = evaluation.evaluate(scored, ("model", "split"), settings.top_share).withColumn("feature_count", counts)
    if keep:
        covered = scored.groupBy("model", "split").agg(
            F.count_if(F.coalesce(*keep).isNotNull()).alias("text_covered_rows")
        )
        report = report.join(covered, ["model", "split"])
    return stage(report, "report")


def compare_esg_lift(dataset: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The model without and with the controversy features, and the difference per split."""
    settings = settings or Settings()
    baseline = settings.baseline_features()
    if not baseline:
        raise ValueError("Baseline feature set is empty after removing ESG controversy features")
    if len(baseline) == len(settings.features):
        raise ValueError("Full feature set does not include ESG controversy features")
    rows = labelled_rows(dataset, settings, purpose="compare ESG lift")
    report = _compare(rows, {"baseline_no_esg": baseline, "full_with_esg": settings.features}, settings)
    return evaluation.with_deltas(report, "baseline_no_esg", "full_with_esg", "full_minus_baseline")


def compare_text_lift(
    dataset: DataFrame, settings: Settings | None = None, text_features: Sequence[str] = TEXT_SIGNALS
) -> DataFrame:
    """The full model without and with the text signals; splits with one class are left out."""
    settings = settings or Settings()
    rows = labelled_rows(dataset, settings, text_features, purpose="compare text lift")
    sets = {
        "full_with_esg": settings.features,
        "full_with_esg_plus_text": (*settings.features, *text_features),
    }
    report = _compare(rows, sets, settings, text_features).where(F.col("roc_auc").isNotNull())
    return evaluation.with_deltas(
        report, "full_with_esg", "full_with_esg_plus_text", "text_minus_full_esg", ["text_covered_rows"]
    )


def compare_algorithms(
    dataset: DataFrame,
    settings: Settings | None = None,
    model_types: Sequence[str] = MODEL_TYPES,
    tune: bool = False,
) -> DataFrame:
    """The three learners on the same splits, with the search result when tuned."""
    settings = settings or Settings()
    rows = labelled_rows(dataset, settings, purpose="compare algorithms")
    scored, best = None, F.when(F.lit(False), F.lit(0.0))
    for kind in model_types:
        params = None
        if tune:
            search = cross_validate(train_rows(rows), settings.features, kind, settings.cv_folds, settings.seed)
            params = search.best_params
            best = best.when(F.col("model") == kind, search.mean_auc)
        part = held_out(fit(train_rows(rows), settings.features, kind, params, settings.seed), rows, kind)
        scored = part if scored is None else scored.unionByName(part)
    report = evaluation.evaluate(stage(scored, "compared"), ("model", "split"), settings.top_share)
    return report.where(F.col("roc_auc").isNotNull()).select(
        "model",
        "split",
        "n_rows",
        "n_positive",
        best.alias("best_cv_roc_auc"),
        *evaluation.METRICS,
        "top_bucket_size",
    )


def tuning_results(
    dataset: DataFrame,
    settings: Settings | None = None,
    model_types: Sequence[str] = MODEL_TYPES,
    run_search: bool = False,
) -> DataFrame:
    """The searched grids and, if run, what won."""
    settings = settings or Settings()
    folds = time_folds(train_rows(labelled_rows(dataset, settings)), settings.features, settings.cv_folds) if run_search else None
    lines = []
    for kind in model_types:
        line = [kind, "not_run", json.dumps(GRIDS[kind], sort_keys=True), "{}", None, None, settings.cv_folds, len(grid(kind))]
        if folds is not None:
            found = _winner(grid(kind), search.areas(folds, kind, grid(kind), settings.seed), settings.cv_folds)
            line[1] = "ok"
            line[3] = json.dumps(found.best_params, sort_keys=True)
            line[4], line[5] = found.mean_auc, found.std_auc
        lines.append(tuple(line))
    return dataset.sparkSession.createDataFrame(
        lines,
        "model string, status string, grid_searched string, best_params string, best_cv_roc_auc double, "
        "cv_roc_auc_std double, n_cv_splits int, n_candidates int",
    )


def test_diagnostics(dataset: DataFrame, settings: Settings | None = None, n_bins: int = 5) -> dict[str, DataFrame]:
    """Confusion and calibration of the full model on the test split."""
    settings = settings or Settings()
    rows = labelled_rows(dataset, settings)
    model = fit(train_rows(rows), settings.features, settings.model_type, None, settings.seed)
    scored = stage(held_out(model, rows, settings.model_type), "diagnosed")
    return {
        "confusion": evaluation.confusion(scored, "test", settings.top_share),
        "calibration": evaluation.calibration(scored, "test", n_bins),
    }

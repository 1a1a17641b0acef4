import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tailspark import Settings
from tailspark.plans import evaluation, modelling, reports

NAMES = ("lagged_ncskew", "lagged_duvol", "controversy_score")
FEW = Settings(features=NAMES, cv_folds=2)
SCHEMA = "ticker string, date date, lagged_ncskew double, lagged_duvol double, controversy_score double, high_crash_risk int"


@pytest.fixture(scope="module")
def dataset(spark):
    rng = np.random.default_rng(7)
    rows = []
    for week in range(20):
        for k, t in enumerate(("AAA", "BBB", "CCC", "DDD")):
            crash = int(k >= 2) if week % 5 else int(k % 2)
            a, b, c = rng.normal(crash, 1.0), rng.normal(0, 2.0), rng.normal(crash * 0.5, 1.0)
            a = None if week == 3 and k == 0 else float(a)
            rows.append((t, dt.date(2020, 1, 3) + dt.timedelta(weeks=week), a, float(b), float(c), crash if week < 19 else None))
    return spark.createDataFrame(rows, SCHEMA).cache()


def newton(x, y, c=1.0):
    """The weighted, L2-penalised logistic fit by Newton steps; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    n = len(y)
    w = c * np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    ridge = np.eye(x.shape[1])
    ridge[0, 0] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (p - y)) + ridge @ beta)
        beta = beta - step
    return beta


@pytest.mark.parametrize("c", [1.0, 0.1])
def test_logistic_fit_equals_newton(dataset, c):
    train = dataset.where("high_crash_risk is not null")
    model = modelling.fit(train, NAMES, params={"classifier__C": c})
    pdf = train.toPandas()
    raw = pdf[list(NAMES)].astype(float)
    filled = raw.fillna(raw.median())
    x = ((filled - filled.mean()) / filled.std(ddof=0)).to_numpy()
    want = newton(x, pdf.high_crash_risk.to_numpy(float), c)
    got = np.r_[model.classifier.intercept, model.classifier.coefficients.toArray()]
    assert np.allclose(got, want, atol=1e-5)
    p = [r.p for r in model.predict(train.orderBy("date", "ticker"), "p").collect()]
    assert all(0 < v < 1 for v in p)


def test_the_gradient_vanishes_at_the_fit_only(dataset):
    train = dataset.where("high_crash_risk is not null")
    model = modelling.fit(train, NAMES)
    at = {r.term: r for r in modelling.optimality(model, train).collect()}
    assert list(at) == ["intercept", *NAMES] and all(abs(r.gradient) < 1e-6 for r in at.values())
    pdf = train.toPandas()
    raw = pdf[list(NAMES)].astype(float)
    filled = raw.fillna(raw.median())
    x = np.column_stack([np.ones(len(raw)), ((filled - filled.mean()) / filled.std(ddof=0)).to_numpy()])
    y, n = pdf.high_crash_risk.to_numpy(float), len(pdf)

    class Moved:
        intercept, coefficients = 0.3, Vectors.dense([0.1, -0.2, 0.5])

    moved = modelling.FittedModel("logistic_regression", model.preparation, Moved(), model.params)
    b = np.array([0.3, 0.1, -0.2, 0.5])
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    want = x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) / n + np.r_[0, b[1:]] / n
    assert np.allclose([r.gradient for r in modelling.optimality(moved, train).collect()], want)
    with pytest.raises(ValueError):
        modelling.optimality(modelling.FittedModel("random_forest", model.preparation, None), train)


def test_a_fit_stops_at_its_optimum_only(spark):
    # nearly equal columns under a small penalty: the loss hardly falls long before its gradient vanishes
    rng = np.random.default_rng(3)
    a, tail = rng.normal(size=3000), np.exp(4 * rng.normal(size=3000))
    rows = [(int(y), float(x), float(x + 0.01 * z), float(t)) for y, x, z, t in zip(a + rng.normal(size=3000) > 1, a, rng.normal(size=3000), tail)]
    train = spark.createDataFrame(rows, f"{modelling.LABEL} int, p double, q double, r double")
    model = modelling.fit(train, ["p", "q", "r"], params={"classifier__C": 100.0})
    assert max(abs(r.gradient) for r in modelling.optimality(model, train).collect()) < 1e-9


def test_training_scoring_and_drivers(spark, dataset):
    trained = modelling.train_classifier(dataset, FEW)
    assert trained.trained_rows == 76 and sum(trained.class_balance.values()) == 76
    assert {r.split for r in trained.metrics.collect()} == {"train", "validation", "test"} - {"train"}
    values = [v for _, v in trained.model.importances()]
    assert values == sorted(values, reverse=True)
    scores = modelling.score_latest(trained.model, dataset)
    assert scores.columns == ["ticker", "as_of_date", "crash_probability", "risk_bucket", "top_drivers"]
    got = scores.collect()
    assert {r.as_of_date for r in got} == {"2020-05-15"} and len(got) == 4
    assert all(set(r.top_drivers.split(";")) == set(NAMES) for r in got)
    early = modelling.score_latest(trained.model, dataset, as_of="2020-01-14").collect()
    assert {r.as_of_date for r in early} == {"2020-01-10"}
    with pytest.raises(ValueError, match="as_of_date"):
        modelling.score_latest(trained.model, dataset, as_of="2019-01-01")


def test_only_train_rows_when_asked(dataset):
    early = modelling.train_classifier(dataset, FEW, fit_on="train")
    full = modelling.train_classifier(dataset, FEW)
    assert early.model.preparation.mean != full.model.preparation.mean


def test_one_class_is_an_error(dataset):
    with pytest.raises(ValueError, match="two target classes"):
        modelling.train_classifier(dataset.where("high_crash_risk = 1"), FEW)


def test_esg_comparison(dataset):
    report = modelling.compare_esg_lift(dataset, FEW).collect()
    assert {r.model for r in report} == {"baseline_no_esg", "full_with_esg", "full_minus_baseline"}
    by = {(r.model, r.split): r for r in report}
    for split in ("validation", "test"):
        base, full, delta = (by[(m, split)] for m in ("baseline_no_esg", "full_with_esg", "full_minus_baseline"))
        assert (base.feature_count, full.feature_count, delta.feature_count) == (2, 3, 1)
        assert math.isclose(full.roc_auc - base.roc_auc, delta.roc_auc, abs_tol=1e-12)
    with pytest.raises(ValueError, match="does not include"):
        modelling.compare_esg_lift(dataset, Settings(features=NAMES[:2]))


def test_tree_models_and_search(dataset):
    train = dataset.where("high_crash_risk is not null")
    for kind, params in (
        ("random_forest", {"classifier__n_estimators": 5, "classifier__max_depth": 3}),
        ("gradient_boosting", {"classifier__n_estimators": 3}),
    ):
        model = modelling.fit(train, NAMES, kind, params)
        assert model.predict(train).where("crash_probability between 0 and 1").count() == 76
        assert len(model.importances()) == 3
    found = modelling.cross_validate(train, NAMES, "logistic_regression", folds=2)
    assert found.candidates == 4 and found.folds == 2 and 0 <= found.mean_auc <= 1
    grids = modelling.tuning_results(dataset, FEW).collect()
    assert [(r.model, r.status, r.n_candidates) for r in grids] == [
        ("logistic_regression", "not_run", 4), ("random_forest", "not_run", 6), ("gradient_boosting", "not_run", 4),
    ]


def scored(spark, rows):
    return spark.createDataFrame(
        [("s%02d" % i, dt.date(2020, 1, 3), "test", y, float(p)) for i, (y, p) in enumerate(rows)],
        "ticker string, date date, split string, high_crash_risk int, crash_probability double",
    )


def test_auc_counts_ties_half_and_skips_single_classes(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 0.4)]
    wins = sum((p > q) + 0.5 * (p == q) for y, p in rows if y for z, q in rows if not z)
    assert math.isclose(evaluation.roc_auc(scored(spark, rows), ["split"]).first().roc_auc, wins / 6)
    assert evaluation.roc_auc(scored(spark, [(1, 0.2), (1, 0.3)]), ["split"]).first().roc_auc is None


def test_confusion_and_empty_calibration_bins(spark):
    df = scored(spark, [(1, 0.95), (0, 0.9), (1, 0.1), (0, 0.0), (0, 1.0)])
    got = {r.threshold: r for r in evaluation.confusion(df).collect()}
    half, top = got["probability_0_50"], got["top_20_percent"]
    assert (half.tp, half.fp, half.tn, half.fn) == (1, 2, 1, 1) and (top.tp, top.fp) == (0, 1)
    bins = {r.bin: r for r in evaluation.calibration(df).collect()}
    assert len(bins) == 5 and bins[3].n_rows == 0 and bins[3].observed_crash_rate is None
    assert bins[5].n_rows == 3 and bins[4].probability_min == 0.6000000000000001
    nothing = scored(spark, [(0, 0.1), (0, 0.2)])
    row = evaluation.class_metrics(nothing).first()
    assert (row.precision, row.recall, row.f1, row.roc_auc) == (0.0, 0.0, 0.0, None)


def test_one_class_fold_has_no_score(spark):
    rows = [(f"T{i % 3}", dt.date(2020, 1, 3) + dt.timedelta(weeks=i), int(i > 20 and i % 2), float(i % 7)) for i in range(60)]
    train = spark.createDataFrame(rows, f"ticker string, date date, {modelling.LABEL} int, x double")
    found = modelling.cross_validate(train, ["x"], "logistic_regression", folds=5, candidates=[{}])
    assert 0 <= found.mean_auc <= 1
    flat = train.withColumn(modelling.LABEL, F.lit(0))
    with pytest.raises(ValueError, match="No fold"):
        modelling.cross_validate(flat, ["x"], "logistic_regression", folds=2, candidates=[{}])


def test_forests_are_deep_unless_bounded(spark):
    assert modelling.DEFAULTS["random_forest"]["classifier__max_depth"] > 12
    forest = modelling._classifier("random_forest", modelling.DEFAULTS["random_forest"] | {"classifier__max_bins": 64}, 1, 10)
    assert forest.getMaxDepth() == 30 and forest.getMaxBins() == 64


def test_top_importances(spark):
    table = spark.createDataFrame([(f"f{i}", float(i % 3)) for i in range(12)], "feature string, importance double")
    assert [r.feature for r in reports.top_importances(table, 3).collect()] == ["f11", "f2", "f5"]

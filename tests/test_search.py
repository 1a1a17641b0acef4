"""Searches over all learners, against fits made one at a time."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tailspark.operators import forest, selection
from tailspark.plans import evaluation, modelling, search, variants

FOLDER = "/root/testdata/sf0.001"
NAMES = ("a", "b", "c")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 3)).round(2)
    y = (x[:, 0] + rng.normal(size=600) > 0.5).astype(int)
    made = [
        (f"T{i % 4}", dt.date(2020, 1, 3) + dt.timedelta(weeks=i // 4), int(y[i]), None if i % 9 == 0 else float(x[i, 0]), float(x[i, 1]), float(i % 3))
        for i in range(600)
    ]
    return spark.createDataFrame(made, f"ticker string, date date, {modelling.LABEL} int, a double, b double, c double").cache()


def test_all_learners_are_searched(spark, monkeypatch):
    small = {
        "logistic_regression": {"classifier__C": [0.1, 1.0]},
        "random_forest": {"classifier__n_estimators": [3], "classifier__max_depth": [2, 3, 13], "classifier__min_samples_leaf": [5]},
        "gradient_boosting": {"classifier__n_estimators": [2], "classifier__max_depth": [2]},
    }
    monkeypatch.setattr(modelling, "GRIDS", small)
    monkeypatch.setattr(variants, "SCRIPT_GRIDS", small)
    tuned = entry.queries()["tuning_results"](spark, FOLDER).collect()
    assert [(r.model, r.status, r.n_cv_splits, r.n_candidates) for r in tuned] == [
        ("logistic_regression", "ok", 5, 2), ("random_forest", "ok", 5, 3), ("gradient_boosting", "ok", 5, 1),
    ]
    assert all(0.0 < r.best_cv_roc_auc < 1.0 for r in tuned)
    held_out = entry.queries()["variant_holdout_search"](spark, FOLDER).collect()
    assert [r.model for r in held_out] == list(modelling.MODEL_TYPES) and all(0.0 < r.best_val_auc < 1.0 for r in held_out)


def test_folds_fitted_together_are_those_fitted_alone(rows):
    folds = modelling.time_folds(rows, NAMES, 3)
    assert folds.lasts == [0, 1, 2]
    candidates = [{"classifier__C": c} for c in (0.01, 1.0)]
    got = search.areas(folds, "logistic_regression", candidates, 42)
    for f, last in enumerate(folds.lasts):
        seen, block = folds.rows.where(F.col("_part") <= last), folds.rows.where(F.col("_part") == last + 1)
        assert block.count() == 150
        alone = modelling.fit_preparation(seen, NAMES)
        assert alone.median == folds.preparations[f].median
        assert np.allclose([alone.mean, alone.scale], [folds.preparations[f].mean, folds.preparations[f].scale])
        for i, params in enumerate(candidates):
            scored = modelling.fit(seen, NAMES, params=params).predict(block).withColumn("k", F.lit(1))
            assert abs(evaluation.roc_auc(scored, ["k"]).first().roc_auc - got[i][f]) < 1e-9


def test_copies_count_as_rows(spark, rows):
    # the cuts and boosted scores of three copies of each row are those of the rows
    folds = [modelling.time_folds(r, NAMES, 2) for r in (rows, rows.crossJoin(spark.range(3)).drop("id"))]
    bins = [{(r.fold, r.held, r["_label"], bytes(r["_bins"])): r["_n"] for r in f.binned(8).collect()} for f in folds]
    assert bins[1] == {k: 3 * n for k, n in bins[0].items()}
    candidate = [{"classifier__n_estimators": 3, "classifier__max_bins": 8}]
    once, thrice = (search.areas(f, "gradient_boosting", candidate, 42)[0] for f in folds)
    assert np.allclose(once, thrice)


def test_a_lower_depth_is_cut_from_the_same_forest(rows):
    folds = modelling.time_folds(rows, NAMES, 2)
    counted = folds.binned(8).where("fold = 1").cache()
    stored, held = search.in_chunks(counted.where("not held")), counted.where("held")

    def means(depth, wanted):
        rules = forest.Rules(3, 8, (0.8, 1.3), depth, 5, 42)
        found = forest.grow_shallow(stored, rules, 6).means(held, wanted, ["_bins", "_label"])
        return {(bytes(r["_bins"]), r["_label"]): r[2:] for r in found.collect()}

    both, low = means(6, [2, 6]), means(2, [2])
    assert {k: v[0] for k, v in both.items()} == {k: v[0] for k, v in low.items()} and any(v[0] != v[1] for v in both.values())
    # grown by groups it is the same forest
    rules = forest.Rules(3, 8, (0.8, 1.3), 6, 5, 42)
    block = held.withColumn("_id", F.monotonically_increasing_id()).cache()
    deep = block.join(forest.grow_deep(stored, rules, 6, []).means(block), "_id").collect()
    assert all(abs(r["_one"] - both[bytes(r["_bins"]), r["_label"]][1]) < 1e-9 for r in deep)


def test_a_row_with_a_count_is_drawn_as_often_as_its_copies(spark):
    rules = forest.Rules(3, 8, (1.0, 1.0), 3, 1, 42)
    for n in (1, 5, forest.CHUNK):
        drawn = rules.copies(np.arange(100_000), 0, np.full(100_000, n))
        assert abs(drawn.mean() - n) < 0.02 * n and abs(drawn.var() - n) < 0.05 * n
    counted = spark.createDataFrame([(0, b"a", 64), (0, b"b", 130), (1, b"a", 1)], "_label int, _bins binary, _n long")
    got = sorted((r["_label"], bytes(r["_bins"]), r["_n"]) for r in search.in_chunks(counted).collect())
    assert got == [(0, b"a", 64), (0, b"b", 2), (0, b"b", 64), (0, b"b", 64), (1, b"a", 1)]


def test_cuts_up_to_a_part(spark):
    df = spark.range(4000).select(
        (F.col("id") / 1000).cast("int").alias("p"), F.when(F.col("id") % 10 > 0, 1.0 + (F.col("id") * 7919 % 4000) / 4000).alias("x"), (F.col("id") % 3).alias("y")
    )
    for last, cuts in zip((1, 3), selection.prefix_cuts(df, ["x", "y"], "p", [1, 3], [[1.5, 0.0]] * 2, 8)):
        x = np.array([r.x if r.x else 1.5 for r in df.where(F.col("p") <= last).collect()])
        below = [(x <= c).mean() for c in cuts[0]]
        # within one cell of 64, and the filled tenth of the rows lies in one bin
        assert len(cuts[0]) >= 6 and all(min(abs(b - i / 8) for i in range(1, 8)) < 0.13 for b in below)
        assert cuts[1] == [0.0, 1.0]

"""The deep forest against a plain recursive one, Spark's own, and itself with other bounds on its groups."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tailspark.operators import forest
from tailspark.plans import evaluation, modelling

N, FEATURES = 900, 7
NAMES = [f"x{i}" for i in range(FEATURES)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(N, FEATURES)), 3)
    x[:, 6] = rng.random(N) < 0.99  # a flag whose smaller value is rare
    odds = 1.5 * x[:, 0] + (x[:, 1] * x[:, 2] > 0) - 1.5
    y = (rng.random(N) < 1 / (1 + np.exp(-odds))).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(N)]
    schema = f"n int, {modelling.LABEL} int, " + ", ".join(f"{c} double" for c in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3, "n").sortWithinPartitions("n").cache()


def fitted(data, trees=6, depth=30, leaf=1, bins=16):
    return forest.fit_forest(data, modelling.LABEL, [F.col(c) for c in NAMES], (0.7, 1.6), trees, depth, leaf, bins, 42)


def probabilities(model, data):
    rows = data.withColumn("_vector", array_to_vector(F.array(*NAMES)))
    return {r.n: float(r._probability[1]) for r in model.transform(rows).collect()}


def plain(rules, tree, node, bins, labels, copies, gains):
    """A node as (share) or (feature, cut, left, right), one node at a time."""
    counts = [sum(c for c, y in zip(copies, labels) if y == k) for k in (0, 1)]

    def pure(n):
        a, b = n[0] * rules.weights[0], n[1] * rules.weights[1]
        return (a * a + b * b) / (a + b) if a + b else 0.0

    best = (0.0,)
    if all(counts) and node.bit_length() - 1 < rules.max_depth:
        for f in rules.slots(np.array([node]), tree)[0]:
            for cut in range(rules.bins - 1):
                left = [sum(copies[(bins[:, f] <= cut) & (labels == k)].tolist()) for k in (0, 1)]
                right = [counts[0] - left[0], counts[1] - left[1]]
                if min(sum(left), sum(right)) >= rules.min_leaf:
                    gain = pure(left) + pure(right) - pure(counts)
                    if gain > 1e-12 * sum(counts) and gain > best[0] + 1e-9:
                        best = (gain, int(f), cut)
    if len(best) == 1:
        return counts[1] * rules.weights[1] / (counts[0] * rules.weights[0] + counts[1] * rules.weights[1])
    gain, f, cut = best
    gains[f] += gain
    low = bins[:, f] <= cut
    return f, cut, *[plain(rules, tree, 2 * node + k, bins[m], labels[m], copies[m], gains) for k, m in ((0, low), (1, ~low))]


def walk(node, row):
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


@pytest.mark.parametrize("depth, leaf", [(30, 1), (13, 7)])
def test_deep_forest_equals_one_grown_node_by_node(spark, data, depth, leaf):
    model = fitted(data, trees=3, depth=depth, leaf=leaf)
    rows = data.select("n", modelling.LABEL, F.monotonically_increasing_id().alias("id"), *NAMES).toPandas()
    bins = np.stack([np.searchsorted(c, rows[f].to_numpy()) for f, c in zip(NAMES, model.cuts)], axis=1)
    labels, total, shares = rows[modelling.LABEL].to_numpy(), np.zeros(N), np.zeros(FEATURES)
    for tree in range(3):
        copies = model.rules.copies(rows.id.to_numpy(), tree).astype(int)
        mine, gains = copies > 0, np.zeros(FEATURES)
        root = plain(model.rules, tree, 1, bins[mine], labels[mine], copies[mine], gains)
        total += [walk(root, row) for row in bins]
        shares += gains / gains.sum()
    got = probabilities(model, data)
    assert np.allclose([got[n] for n in rows.n], total / 3, atol=1e-9)
    assert np.allclose(model.featureImportances.toArray(), shares / 3)


def test_upper_nodes_by_histograms_are_those_of_a_group(data, monkeypatch):
    whole = fitted(data)
    assert all(len(top.heap) == 1 for top in whole.tops) and whole.subtrees.count() == 6
    monkeypatch.setattr(forest, "SMALL", 20)
    monkeypatch.setattr(forest, "LARGE", 60)
    monkeypatch.setattr(forest, "BLOCK", 100)
    monkeypatch.setattr(forest, "CELLS", 100)
    monkeypatch.setattr(forest, "SLICE", 250)
    cut = fitted(data)
    for top in cut.tops:
        leaves = top.feature == -1
        assert len(top.heap) > 10 and (top.total[leaves].sum(axis=1) <= 60).mean() > 0.5
    assert cut.subtrees.count() == sum((top.feature == -1).sum() for top in cut.tops)
    assert probabilities(cut, data) == probabilities(whole, data)
    assert np.allclose(cut.featureImportances.toArray(), whole.featureImportances.toArray())


def test_copies_of_one_row_end_in_a_leaf_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(forest, "SMALL", 20)
    monkeypatch.setattr(forest, "LARGE", 20)
    rows = spark.range(400).select(
        F.col("id").cast("int").alias("n"), (F.col("id") % 4 == 0).cast("int").alias(modelling.LABEL),
        *[F.lit(1.0).alias(c) for c in NAMES[1:]], (F.col("id") < 40).cast("double").alias(NAMES[0]),
    )
    model = fitted(rows.select("n", modelling.LABEL, *NAMES), trees=4)
    got = probabilities(model, rows)
    assert len(got) == 400 and len({round(p, 12) for p in got.values()}) <= 2


def test_the_default_forest_is_as_good_as_spark_s(data, monkeypatch):
    train, rest = data.where("n % 3 > 0").cache(), data.where("n % 3 = 0").withColumn("split", F.lit("test"))

    def area(model):
        return evaluation.roc_auc(model.predict(rest), ["split"]).first().roc_auc

    params = {"classifier__n_estimators": 30}
    ours = modelling.fit(train, NAMES, "random_forest", params)
    assert isinstance(ours.classifier, forest.DeepForest)
    monkeypatch.setattr(modelling, "SHALLOW", 30)
    theirs = modelling.fit(train, NAMES, "random_forest", params)
    assert not isinstance(theirs.classifier, forest.DeepForest)
    assert area(ours) > area(theirs) - 0.03 and area(ours) > 0.75
    assert ours.importances()[0][0] == theirs.importances()[0][0] == "x0"
    assert np.allclose([v for _, v in ours.importances()], [v for _, v in theirs.importances()], atol=0.08)


def test_cuts_hold_all_of_few_values(data):
    cuts = forest.thresholds(data.select(F.array(*NAMES).alias("_x")), FEATURES, 16)
    assert cuts[6] == [0.0] and all(len(c) == 15 for c in cuts[:6])
    for c, name in zip(cuts[:6], NAMES):
        values = np.sort([r[0] for r in data.select(name).collect()])
        assert np.abs(np.searchsorted(values, c) / N - np.arange(1, 16) / 16).max() < 0.01


def test_bootstrap_and_drawn_features():
    rules = forest.Rules(20, 32, (1.0, 1.0), 30, 1, 42)
    copies = [rules.copies(np.arange(200_000) + (1 << 33), tree) for tree in (0, 1)]
    for k in range(4):
        assert abs((copies[0] == k).mean() - math.exp(-1) / math.factorial(k)) < 0.005
    assert abs(np.corrcoef(copies)[0, 1]) < 0.01
    slots = rules.slots(np.arange(1, 20_001), 0)
    assert slots.shape == (20_000, 5) and all(len(set(s)) == 5 for s in slots[:100].tolist())
    assert np.abs(np.bincount(slots.ravel(), minlength=20) / 20_000 - 0.25).max() < 0.02

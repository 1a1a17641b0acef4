"""Deep random forests: upper nodes by summed histograms over all rows, lower ones by a grouping on (tree, node).

Spark's own forest passes over all rows for every batch of nodes, and a deep forest has millions of tiny ones. Here
only nodes of more than an eighth of the rows (or `LARGE`, or `SMALL`) are split that way. A smaller node's rows are
sent to one group, which grows the rest of its subtree, and the subtrees stay a table.

The rules are those of Spark's forest: a Poisson(1) bootstrap per tree, ceil(sqrt(features)) features drawn per node,
Gini gain on weighted counts, one threshold out of at most `max_bins` bins, leaves where nothing is gained. Leaves of
one class are not merged with each other, as in the method. Draws are hashes of (seed, tree, row or node), and counts
are whole numbers, so the forest is the same wherever its nodes are grown.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.staging import stage

SMALL = 1 << 16  # a node of so many rows, repeats of the bootstrap counted, is always grown by one group
LARGE = 1 << 22  # one of more never is
BLOCK = 1 << 15  # rows a task holds at once
CELLS = 1 << 20  # histogram cells worked out at once
SLICE = 1 << 22  # scored rows that may meet at one node
UNIT = float(1 << 40)  # probabilities are added up as whole numbers, so their order does not matter

CHUNK = 64  # equal rows that one row with a count stands for
NEAR = 64  # nodes whose histograms meet in one group

_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(16)])
PACKED = "tree int, root long, slice int, keys binary, bins binary"
SPLIT = "tree int, place int, feature int, cut int, gain double, all0 double, all1 double, left0 double, left1 double"
SUBTREE = "tree int, root long, feature binary, cut binary, child binary, share binary, importance array<double>"


@cache
def _poisson(mean: int) -> np.ndarray:
    """Running totals of the chances of 0, 1, ... draws."""
    if mean == 1:
        return _POISSON
    return np.cumsum([math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(200)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 step: neighbouring numbers to unrelated ones."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tree_key(seed: int, tree: int, use: int) -> np.ndarray:
    return _mixed(_mixed(np.array([seed & (2**63 - 1)], np.uint64)) + np.uint64(2 * tree + use))


@dataclass(frozen=True)
class Rules:
    features: int
    bins: int
    weights: tuple[float, float]
    max_depth: int
    min_leaf: int
    seed: int

    @property
    def drawn(self) -> int:
        return math.ceil(math.sqrt(self.features))

    def copies(self, ids: np.ndarray, tree: int, counts: np.ndarray | None = None) -> np.ndarray:
        """How often the bootstrap of a tree holds each row, or all of the equal rows that one with a count stands for."""
        drawn = _mixed(_mixed(ids.astype(np.uint64)) ^ _tree_key(self.seed, tree, 0))
        share = (drawn >> np.uint64(11)) * 2.0**-53
        if counts is None:
            return np.searchsorted(_POISSON, share, side="right").astype(np.uint8)
        out = np.zeros(len(ids), np.uint8)
        for n in np.unique(counts):
            same = counts == n
            # independent Poisson draws add up to a Poisson draw
            out[same] = np.searchsorted(_poisson(int(n)), share[same], side="right")
        return out

    def slots(self, nodes: np.ndarray, tree: int) -> np.ndarray:
        """The features drawn for each node, ascending."""
        of_node = _mixed(_mixed(nodes.astype(np.uint64)) ^ _tree_key(self.seed, tree, 1))
        order = _mixed(of_node[:, None] + np.arange(1, self.features + 1, dtype=np.uint64))
        return np.sort(np.argsort(order, axis=1)[:, : self.drawn], axis=1)

    def share(self, counts: np.ndarray) -> np.ndarray:
        """The weighted share of class 1."""
        weighted = counts * np.array(self.weights)
        return weighted[..., 1] / weighted.sum(-1)

    def histogram(self, bins, labels, copies, place, slots) -> np.ndarray:
        """(node, drawn feature, bin, class) -> rows."""
        n, width = len(slots), self.bins * 2
        rows, out = np.arange(len(place)), np.empty((n, self.drawn, width))
        for j in range(self.drawn):
            cell = place * width + bins[rows, slots[place, j]].astype(np.int64) * 2 + labels
            out[:, j] = np.bincount(cell, weights=copies, minlength=n * width).reshape(n, width)
        return out.reshape(n, self.drawn, self.bins, 2)

    def best(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per node: drawn feature, bin (rows up to it go left), weighted gain (0: no split), rows left by class."""
        left = hist[:, :, :-1].cumsum(axis=2)
        right = hist[:, :1].sum(axis=2)[:, :, None] - left
        usable = (left.sum(-1) >= self.min_leaf) & (right.sum(-1) >= self.min_leaf)

        def pure(counts):
            a, b = counts[..., 0] * self.weights[0], counts[..., 1] * self.weights[1]
            return (a * a + b * b) / np.maximum(a + b, 1e-300)

        total = hist[:, 0].sum(axis=1)
        gain = pure(left) + pure(right) - pure(total)[:, None, None]
        gain = np.where(usable & (gain > 1e-12 * total.sum(-1)[:, None, None]), gain, 0.0).reshape(len(hist), -1)
        at = gain.argmax(axis=1)
        slot, cut = np.divmod(at, self.bins - 1)
        nodes = np.arange(len(hist))
        return slot, cut, gain[nodes, at], left[nodes, slot, cut]


class Nodes:
    """Nodes of one (sub)tree: the feature (-1: a leaf), the last bin that goes left, the left child (the right one follows) and the share."""

    def __init__(self, root: int, total=(0.0, 0.0)):
        self.heap, self.total = np.array([root], np.int64), np.array([total], float)
        self.feature, self.cut, self.child = np.array([-1], np.int16), np.zeros(1, np.int16), np.zeros(1, np.int32)

    def split(self, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Split these nodes; the places of their left children."""
        first = len(self.heap) + 2 * np.arange(len(at))
        self.feature[at], self.cut[at], self.child[at] = feature, cut, first
        heap = np.stack([2 * self.heap[at], 2 * self.heap[at] + 1], axis=1).ravel()
        total = np.stack([left, self.total[at] - left], axis=1).reshape(-1, 2)
        more = len(heap)
        self.heap, self.total = np.concatenate([self.heap, heap]), np.concatenate([self.total, total])
        self.feature = np.concatenate([self.feature, np.full(more, -1, np.int16)])
        self.cut = np.concatenate([self.cut, np.zeros(more, np.int16)])
        self.child = np.concatenate([self.child, np.zeros(more, np.int32)])
        return first

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        return descend(bins, self.feature, self.cut, self.child)

    def divisible(self, at: np.ndarray, rules: Rules) -> np.ndarray:
        """Whether both classes and more depth are left."""
        depth = np.floor(np.log2(self.heap[at])).astype(int)
        return (self.total[at] > 0).all(axis=1) & (depth < rules.max_depth)


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The place of the leaf that each row reaches."""
    at, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[at[rows]] >= 0]
        here = at[rows]
        at[rows] = child[here] + (bins[rows, feature[here]] > cut[here])
    return at


def grow(rules: Rules, tree: int, root: int, bins, labels, copies) -> tuple[Nodes, np.ndarray]:
    """The whole subtree of one node's rows, level by level, and the weighted gain of each feature."""
    nodes = Nodes(root, np.bincount(labels, weights=copies, minlength=2))
    importance = np.zeros(rules.features)
    rows, at = np.arange(len(labels)), np.zeros(len(labels), np.int64)
    step = max(1, CELLS // (rules.drawn * rules.bins * 2))
    level = np.zeros(1, np.int64)
    while len(level := level[nodes.divisible(level, rules)]):
        place = np.full(len(nodes.heap), -1)
        place[level] = np.arange(len(level))
        rows, at = rows[place[at] >= 0], at[place[at] >= 0]
        order = np.argsort(place[at], kind="stable")
        rows, at = rows[order], at[order]
        ends = np.searchsorted(place[at], np.arange(0, len(level) + step, step))
        found = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            part, mine = level[i * step : (i + 1) * step], rows[a:b]
            slots = rules.slots(nodes.heap[part], tree)
            hist = rules.histogram(bins[mine], labels[mine], copies[mine], place[at[a:b]] - i * step, slots)
            slot, cut, gain, left = rules.best(hist)
            found.append((slots[np.arange(len(part)), slot], cut, gain, left))
        feature, cut, gain, left = (np.concatenate(x) for x in zip(*found))
        won = gain > 0
        np.add.at(importance, feature[won], gain[won])
        first = nodes.split(level[won], feature[won], cut[won], left[won])
        at = np.where(nodes.feature[at] >= 0, nodes.child[at] + (bins[rows, nodes.feature[at]] > nodes.cut[at]), 0)
        level = np.stack([first, first + 1], axis=1).ravel()
    return nodes, importance


def _bin_type(bins: int) -> type:
    return np.uint8 if bins <= 256 else np.uint16


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _blocks(batches, rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(ids, labels, bins, counts if there are any) of up to `BLOCK` rows."""
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = table["_id"].to_numpy(), table["_label"].to_numpy().astype(np.int64)
        counts = table["_n"].to_numpy() if "_n" in table.column_names else None
        return ids, labels, _matrix(table["_bins"], rules.features, _bin_type(rules.bins)), counts

    for batch in batches:
        if n and n + batch.num_rows > BLOCK:
            yield joined()
            held, n = [], 0
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
    if n:
        yield joined()


def thresholds(rows: DataFrame, features: int, max_bins: int) -> list[list[float]]:
    """Ascending cuts of each element of `_x`: all distinct values if these are few, else quantiles; the largest value is none."""
    xs = [F.element_at("_x", i + 1) for i in range(features)]
    places = [i / max_bins for i in range(1, max_bins)]
    first = rows.agg(
        *[F.approx_count_distinct(x, 0.02).alias(f"n{i}") for i, x in enumerate(xs)],
        *[F.percentile_approx(x, places, 100 * max_bins).alias(f"q{i}") for i, x in enumerate(xs)],
        *[F.min(x).alias(f"a{i}") for i, x in enumerate(xs)],
        *[F.max(x).alias(f"b{i}") for i, x in enumerate(xs)],
    ).first()
    few = [i for i in range(features) if first[f"n{i}"] <= 2 * max_bins]
    sets = rows.agg(F.lit(0).alias("none"), *[F.collect_set(xs[i]).alias(f"s{i}") for i in few]).first()
    cuts = []
    for i in range(features):
        if i in few and len(sets[f"s{i}"]) <= max_bins:
            found = set(sets[f"s{i}"])
        else:
            found = set(first[f"q{i}"])
            if len(found) < max_bins - 1:
                found.add(first[f"a{i}"])
        cuts.append(sorted(v for v in found if v < first[f"b{i}"]))
    return cuts


def _binned(rows: DataFrame, cuts: list[list[float]], kind: type) -> DataFrame:
    """`_x` replaced by the row's bins, one number a feature, and a row number `_id`."""
    edges = [np.array(c, float) for c in cuts]

    @F.pandas_udf("binary")
    def bins(x: pd.Series) -> pd.Series:
        values = np.array(x.tolist(), float).reshape(len(x), len(edges))
        out = np.empty(values.shape, kind)
        for i, edge in enumerate(edges):
            out[:, i] = np.searchsorted(edge, values[:, i], side="left")
        return pd.Series([row.tobytes() for row in out])

    kept = [c for c in rows.columns if c != "_x"]
    return stage(rows.select(*kept, F.monotonically_increasing_id().alias("_id"), bins("_x").alias("_bins")), "binned")


def _open_nodes(tops: list[Nodes], closed: list[set[int]], rules: Rules, bound: int) -> list[np.ndarray]:
    """Places of leaves that may be split and hold more rows than `bound`."""
    found = []
    for top, shut in zip(tops, closed):
        leaves = np.setdiff1d(np.flatnonzero(top.feature == -1), list(shut)).astype(int)
        leaves = leaves[top.divisible(leaves, rules)]
        found.append(leaves[top.total[leaves].sum(axis=1) > bound])
    return found


def _split_open(rows: DataFrame, tops: list[Nodes], opened: list[np.ndarray], rules: Rules) -> list:
    """One pass over all rows: the split of each open node, feature -1 where nothing is gained."""

    def count(batches):
        found: dict[int, np.ndarray] = {}
        for ids, labels, bins, counts in _blocks(batches, rules):
            for tree, nodes in enumerate(opened):
                if not len(nodes):
                    continue
                copies = rules.copies(ids, tree, counts)
                mine = np.flatnonzero(copies)
                place = np.full(len(tops[tree].heap), -1)
                place[nodes] = np.arange(len(nodes))
                place = place[tops[tree].leaf_of(bins[mine])]
                mine, place = mine[place >= 0], place[place >= 0]
                slots = rules.slots(tops[tree].heap[nodes], tree)
                hist = rules.histogram(bins[mine], labels[mine], copies[mine], place, slots)
                found[tree] = found[tree] + hist if tree in found else hist
        for tree, hist in found.items():
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([tree] * len(hist), pa.int32()),
                "place": pa.array(opened[tree], pa.int32()),
                "counts": pa.array([h.astype(np.int64).tobytes() for h in hist], pa.binary()),
            })

    def choose(key, table):
        tree = key[0].as_py()
        places, at = np.unique(table["place"].to_numpy(), return_inverse=True)
        total = np.zeros((len(places), rules.drawn, rules.bins, 2))
        for i, counts in zip(at, table["counts"]):
            total[i] += np.frombuffer(counts.as_buffer(), np.int64).reshape(total.shape[1:])
        slot, cut, gain, left = rules.best(total)
        slots = rules.slots(tops[tree].heap[places], tree)
        feature = np.where(gain > 0, slots[np.arange(len(places)), slot], -1)
        whole = [np.full(len(places), tree), places, feature, cut]
        numbers = [gain, *total[:, 0].sum(axis=1).T, *left.T]
        columns = [pa.array(v.astype(np.int32)) for v in whole] + [pa.array(v.astype(float)) for v in numbers]
        return pa.Table.from_arrays(columns, [part.split()[0] for part in SPLIT.split(", ")])

    counted = rows.select(*_read(rows)).mapInArrow(count, "tree int, place int, counts binary")
    return counted.groupBy("tree", (F.col("place") / NEAR).cast("int")).applyInArrow(choose, SPLIT).collect()


def _read(rows: DataFrame) -> list[str]:
    return [c for c in ("_id", "_label", "_bins", "_n") if c in rows.columns]


def _packed(
    rows: DataFrame, tops: list[Nodes], rules: Rules, growing: list[np.ndarray] | None = None, slices: int = 1
) -> DataFrame:
    """Rows by (tree, upper leaf), as runs of bytes: the labels and copies of the bootstrap at `growing` leaves, else all rows and their ids."""

    def pack(batches):
        for ids, labels, bins, counts in _blocks(batches, rules):
            for tree, top in enumerate(tops):
                leaf = top.leaf_of(bins)
                if growing is None:
                    keys, mine = ids[:, None], np.arange(len(ids))
                else:
                    copies = rules.copies(ids, tree, counts)
                    keys = np.stack([labels.astype(np.uint8), copies], axis=1)
                    mine = np.flatnonzero((copies > 0) & np.isin(leaf, growing[tree]))
                if not len(mine):
                    continue
                part = ids % slices
                group = leaf[mine] * slices + part[mine]
                order = np.argsort(group, kind="stable")
                mine, starts = mine[order], np.flatnonzero(np.diff(group[order], prepend=-1))
                ends = np.append(starts[1:], len(mine))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([tree] * len(starts), pa.int32()),
                    "root": pa.array(top.heap[leaf[mine[starts]]], pa.int64()),
                    "slice": pa.array(part[mine[starts]], pa.int32()),
                    "keys": pa.array([keys[mine[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    "bins": pa.array([bins[mine[a:b]].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                })

    return rows.select(*_read(rows)).mapInArrow(pack, PACKED)


def _subtree_row(tree: int, nodes: Nodes, rules: Rules, importance: np.ndarray) -> tuple:
    shares = rules.share(nodes.total)
    return (
        tree, int(nodes.heap[0]), nodes.feature.tobytes(), nodes.cut.tobytes(), nodes.child.tobytes(),
        shares.tobytes(), [float(x) for x in importance],
    )


@dataclass(frozen=True)
class DeepForest:
    """A fitted forest: upper nodes here, subtrees as a stored table of (tree, root)."""

    rules: Rules
    cuts: list[list[float]]
    tops: list[Nodes]
    subtrees: DataFrame
    featureImportances: DenseVector

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `_probability`, the mean of the leaves' shares over the trees, in place of `_vector`."""
        rows = _binned(df.withColumn("_x", vector_to_array("_vector")).drop("_vector"), self.cuts, _bin_type(self.rules.bins))
        both = array_to_vector(F.array(1.0 - F.col("_one"), F.col("_one")))
        return rows.join(self.means(rows), "_id").select(*[c for c in df.columns if c != "_vector"], both.alias("_probability"))

    def means(self, rows: DataFrame) -> DataFrame:
        """(_id, _one): the mean of the leaves' shares, of stored rows with an `_id` of their own and `_bins`."""
        rules, trees = self.rules, len(self.tops)
        kind = _bin_type(rules.bins)
        slices = 1 + rows.count() // SLICE
        packed = _packed(rows.select("_id", F.lit(0).alias("_label"), "_bins"), self.tops, rules, slices=slices)
        subtrees = self.subtrees.drop("importance").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

        def score(key, left, right):
            ids = np.frombuffer(b"".join(left["keys"].to_pylist()), np.int64)
            share = np.full(len(ids), 0.5)  # a tree whose bootstrap is empty
            if right.num_rows:
                tree = right.to_pylist()[0]
                bins = _matrix(left["bins"], rules.features, kind)
                place = descend(
                    bins, np.frombuffer(tree["feature"], np.int16), np.frombuffer(tree["cut"], np.int16),
                    np.frombuffer(tree["child"], np.int32),
                )
                share = np.frombuffer(tree["share"], float)[place]
            return pa.table({"_id": ids, "_share": np.rint(share * UNIT).astype(np.int64)})

        keys = ("tree", "root", "slice")
        shares = packed.groupBy(*keys).cogroup(subtrees.groupBy(*keys)).applyInArrow(score, "_id long, _share long")
        return shares.groupBy("_id").agg((F.sum("_share") / F.lit(UNIT * trees)).alias("_one"))


def fit_forest(
    rows: DataFrame,
    label: str,
    features: Sequence[Column],
    weights: tuple[float, float],
    n_trees: int,
    max_depth: int,
    min_leaf: int,
    max_bins: int,
    seed: int,
) -> DeepForest:
    """Fit on stored rows, a label of 0 and 1 whose rows weigh `weights`, and features without nulls."""
    source = rows.select(F.col(label).cast("int").alias("_label"), F.array(*features).alias("_x"))
    cuts = thresholds(source, len(features), max_bins)
    rules = Rules(len(features), max_bins, weights, max_depth, min_leaf, seed)
    return grow_deep(_binned(source, cuts, _bin_type(rules.bins)), rules, n_trees, cuts)


def _sizes(stored: DataFrame) -> dict[int, int]:
    rows = F.sum("_n") if "_n" in stored.columns else F.count("*")
    return {r["_label"]: r.n for r in stored.groupBy("_label").agg(rows.alias("n")).collect()}


def grow_upper(
    stored: DataFrame, rules: Rules, n_trees: int, sizes: dict[int, int], bound: int
) -> tuple[list[Nodes], list[set[int]], np.ndarray]:
    """Nodes of more than `bound` rows, split by summed histograms: with 0 the whole trees. The closed leaves and the features' gains."""
    # near enough to tell whether a root is large; exact counts follow from its histogram or in its group
    tops = [Nodes(1, (sizes.get(0, 0), sizes.get(1, 0))) for _ in range(n_trees)]
    gains, closed = np.zeros((n_trees, rules.features)), [set() for _ in tops]
    while sum(map(len, opened := _open_nodes(tops, closed, rules, bound))):
        for r in _split_open(stored, tops, opened, rules):
            top = tops[r.tree]
            top.total[r.place] = r.all0, r.all1
            if r.feature < 0:
                closed[r.tree].add(r.place)
                continue
            gains[r.tree, r.feature] += r.gain
            top.split(np.array([r.place]), np.array([r.feature]), np.array([r.cut]), np.array([[r.left0, r.left1]]))
    return tops, closed, gains


def grow_deep(stored: DataFrame, rules: Rules, n_trees: int, cuts: list[list[float]]) -> DeepForest:
    """Grow on stored rows of bins: `_id`, `_label`, `_bins`, and `_n` where a row stands for up to `CHUNK` equal ones."""
    spark, sizes = stored.sparkSession, _sizes(stored)
    bound = min(max(SMALL, sum(sizes.values()) // 8), LARGE)
    tops, closed, gains = grow_upper(stored, rules, n_trees, sizes, bound)
    growing, ready = [_open_nodes([top], [shut], rules, 0)[0] for top, shut in zip(tops, closed)], []
    for tree, top in enumerate(tops):
        for place in np.setdiff1d(np.flatnonzero(top.feature == -1), growing[tree]):
            done = Nodes(int(top.heap[place]), top.total[place])
            ready.append(_subtree_row(tree, done, rules, np.zeros(rules.features)))

    def finish(key, table):
        tree, root = key[0].as_py(), key[1].as_py()
        keys = _matrix(table["keys"], 2, np.uint8)
        bins = _matrix(table["bins"], rules.features, _bin_type(rules.bins))
        nodes, importance = grow(rules, tree, root, bins, keys[:, 0].astype(np.int64), keys[:, 1])
        row = _subtree_row(tree, nodes, rules, importance)
        names = [part.split()[0] for part in SUBTREE.split(", ")]
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    grown = _packed(stored, tops, rules, growing).groupBy("tree", "root").applyInArrow(finish, SUBTREE)
    subtrees = stage(grown.unionByName(spark.createDataFrame(ready, SUBTREE)), "subtrees")
    lower = subtrees.select("tree", F.posexplode("importance").alias("place", "gain"))
    for r in lower.groupBy("tree", "place").agg(F.sum("gain").alias("gain")).collect():
        gains[r.tree, r.place] += r.gain
    # each tree's importances add up to one before they are averaged
    sums = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(axis=0)
    return DeepForest(rules, cuts, tops, subtrees, Vectors.dense(mean / mean.sum() if mean.sum() > 0 else mean))


@dataclass(frozen=True)
class ShallowForest:
    """Trees of a few levels, all nodes here. Cut off at a lower depth they are the trees of that depth, as draws go by node."""

    rules: Rules
    tops: list[Nodes]

    def means(self, rows: DataFrame, depths: Sequence[int], keep: Sequence[str]) -> DataFrame:
        """(keep, _one0, _one1, ...): the mean share at each depth of rows with `_bins`."""
        rules, tops, width = self.rules, self.tops, self.rules.features
        kind = _bin_type(rules.bins)
        # a tree whose bootstrap is empty is undecided
        shares = [np.where(t.total.sum(axis=1) > 0, rules.share(np.maximum(t.total, 1e-300)), 0.5) for t in tops]

        def score(batches):
            for batch in batches:
                bins, found = _matrix(batch.column("_bins"), width, kind), np.zeros((len(depths), batch.num_rows))
                for top, share in zip(tops, shares):
                    at, every = np.zeros(batch.num_rows, np.int64), np.arange(batch.num_rows)
                    for level in range(max(depths) + 1):
                        for i, depth in enumerate(depths):
                            if depth == level:
                                found[i] += np.rint(share[at] * UNIT)
                        inner = top.feature[at] >= 0
                        right = bins[every, np.maximum(top.feature[at], 0)] > top.cut[at]
                        at = np.where(inner, top.child[at] + right, at)
                columns = [batch.column(c) for c in keep] + [pa.array(f / (UNIT * len(tops))) for f in found]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *[f"_one{i}" for i in range(len(depths))]])

        schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep], *[f"_one{i} double" for i in range(len(depths))]])
        return rows.select(*dict.fromkeys([*keep, "_bins"])).mapInArrow(score, schema)


def grow_shallow(stored: DataFrame, rules: Rules, n_trees: int) -> ShallowForest:
    """As `grow_deep`, but every level is a pass over the rows: right for trees of a few levels."""
    return ShallowForest(rules, grow_upper(stored, rules, n_trees, _sizes(stored), 0)[0])

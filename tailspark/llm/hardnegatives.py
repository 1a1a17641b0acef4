"""Hard negatives by inner product from STR-packed R-trees.

Rows are dealt into ranges of label and first component. Each task packs its rows into trees,
`TREE_ROWS` at a time, by sort-tile-recursive: sorted by label into slabs, each slab by the component
that varies most into slabs, and so on, until a tile is a leaf; each node has the least box around its
rows. A box gives every component an interval, and so an interval for its inner product with an
anchor. A best-first queue takes boxes by their upper bound. It passes over those outside an
anchor's score windows, those whose bound lies strictly below the k-th score found so far, and those
whose labels all are (or none is) the anchor's; what it finds is exact.

Anchors grow with the rows, so they go to the tasks in blocks of at most `BLOCK` anchors. A block makes
two passes: positives first, whose scores set the windows of the second. The lists of all trees
of a task are merged in the task, those of the tasks by Spark.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import stage

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
LEAF, FANOUT, TREE_ROWS, BLOCK = 256, 8, 32_768, 8_192
TASK_ROWS = 250_000
NO_ID = np.iinfo(np.int64).max  # stands for a missing vec_id, which comes last
EXACT = 2**53


def quantised(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, vector) with whole components; rows without label or vector or with a component that is missing or
    not finite take no part."""
    held = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # NaN is above infinity
    return held.filter(finite).select("vec_id", "label", F.transform("x", lambda v: F.floor(F.lit(scale) * v)).alias("vector"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` numbers; shorter vectors end in zeros."""
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy().astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    of = np.repeat(np.arange(len(sizes)), sizes)
    out[of, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def str_order(labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in tile order: by label, then by the components that vary most, each cut into slabs of whole leaves."""
    leaves = math.ceil(len(labels) / leaf)
    by_label = min(len(np.unique(labels)), leaves)
    deep = max(0, math.ceil(math.log2(max(1, leaves / max(1, by_label)))))
    coordinates = np.argsort(-vectors.var(axis=0), kind="stable")[:deep] if len(labels) else []

    def tiled(index: np.ndarray, level: int) -> list[np.ndarray]:
        if len(index) <= leaf or level > len(coordinates):
            return [index]
        key = labels[index] if level == 0 else vectors[index, coordinates[level - 1]]
        index = index[np.argsort(key, kind="stable")]
        slabs = by_label if level == 0 else 2
        step = leaf * math.ceil(math.ceil(len(index) / leaf) / slabs)
        return [x for i in range(0, len(index), step) for x in tiled(index[i : i + step], level + 1)]

    return np.concatenate(tiled(np.arange(len(labels)), 0))


class PackedTree:
    """Leaves of `leaf` rows in tile order; `fanout` neighbours make a node of the next level, up to one root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        order = str_order(labels, vectors, leaf)
        self.ids, self.labels, self.vectors, self.leaf, self.fanout = ids[order], labels[order], vectors[order], leaf, fanout
        low = high = self.vectors
        label_low = label_high = self.labels
        self.levels, width = [], leaf
        while not self.levels or len(low) > 1:
            at = np.arange(0, len(low), width)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            label_low, label_high = np.minimum.reduceat(label_low, at), np.maximum.reduceat(label_high, at)
            self.levels.append((low, high, label_low, label_high))
            width = fanout


@dataclass
class Goals:
    """What one anchor looks for: for each window of scores the `k` best rows. thresholds: the least score that still matters."""

    low: np.ndarray
    high: np.ndarray
    k: int
    scores: list = field(default_factory=list)
    ids: list = field(default_factory=list)

    def __post_init__(self):
        self.scores = [np.empty(0) for _ in self.low]
        self.ids = [np.empty(0, np.int64) for _ in self.low]
        self.thresholds = self.low.astype(float).copy()

    def take(self, goal: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge rows; higher scores first, then smaller ids; a pair of score and id counts once."""
        s, i = np.concatenate([self.scores[goal], scores]), np.concatenate([self.ids[goal], ids])
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        self.scores[goal], self.ids[goal] = s[new][: self.k], i[new][: self.k]
        if len(self.scores[goal]) == self.k:
            self.thresholds[goal] = max(self.low[goal], self.scores[goal][-1])


def search(tree: PackedTree, anchor: int, label: int, vector: np.ndarray, goals: Goals, same: bool) -> int:
    """Best-first search for one anchor among rows of its label (`same`) or of others; the number of leaves it opened."""
    plus, minus = np.maximum(vector, 0.0), np.minimum(vector, 0.0)

    def opened(level: int, start: int, stop: int) -> list[tuple]:
        low, high, label_low, label_high = (x[start:stop] for x in tree.levels[level])
        upper, lower = high @ plus + low @ minus, low @ plus + high @ minus
        fits = (label_low <= label) & (label <= label_high) if same else (label_low != label) | (label_high != label)
        return [(-u, level, start + i, l) for i, (u, l, f) in enumerate(zip(upper.tolist(), lower.tolist(), fits.tolist())) if f]

    queue = opened(len(tree.levels) - 1, 0, 1)
    leaves = 0
    while queue:
        upper, level, node, lower = heapq.heappop(queue)
        reach = -upper >= goals.thresholds
        if not reach.any():
            break  # no box left in the queue reaches higher
        if not (reach & (lower <= goals.high)).any():
            continue
        if level:
            for child in opened(level - 1, node * tree.fanout, (node + 1) * tree.fanout):
                heapq.heappush(queue, child)
            continue
        leaves += 1
        rows = slice(node * tree.leaf, (node + 1) * tree.leaf)
        scores, ids = tree.vectors[rows] @ vector, tree.ids[rows]
        fits = ((tree.labels[rows] == label) & (ids != anchor)) if same else tree.labels[rows] != label
        inside = (scores >= goals.thresholds[:, None]) & (scores <= goals.high[:, None]) & fits
        for goal in np.flatnonzero(inside.any(axis=1)).tolist():
            goals.take(goal, scores[inside[goal]], ids[inside[goal]])
    return leaves


@dataclass
class Anchors:
    """A block of anchors; windows: for each anchor its score windows, (2, g)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list
    k: int
    same: bool


LISTED = "anchor int, goal int, score long, vec_id long"
_LISTED = pa.schema([("anchor", pa.int32()), ("goal", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _searched(shared, width: int):
    def run(batches):
        block: Anchors = shared.value
        goals = [Goals(w[0], w[1], block.k) for w in block.windows]
        held, rows = [], 0

        def search_all():
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
            tree = PackedTree(ids, labels, vectors)
            for i in range(len(goals)):
                if len(goals[i].low):
                    search(tree, block.ids[i], block.labels[i], block.vectors[i], goals[i], block.same)

        for batch in batches:
            for start in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(start, TREE_ROWS)
                ids = part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                held.append((ids, part.column("label").to_numpy(zero_copy_only=False), matrix(part.column("vector"), width)))
                rows += part.num_rows
                if rows >= TREE_ROWS:
                    search_all()
                    held, rows = [], 0
        if held:
            search_all()
        found = [(i, g, s, x) for i, own in enumerate(goals) for g in range(len(own.low)) for s, x in [(own.scores[g], own.ids[g])] if len(s)]
        for start in range(0, len(found), 10_000):
            part = found[start : start + 10_000]
            sizes = [len(s) for _, _, s, _ in part]
            ids = np.concatenate([x for _, _, _, x in part])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([i for i, *_ in part], np.int32), sizes)),
                    pa.array(np.repeat(np.array([g for _, g, *_ in part], np.int32), sizes)),
                    pa.array(np.concatenate([s for _, _, s, _ in part]).astype(np.int64)),
                    pa.array(ids, mask=ids == NO_ID),
                ],
                schema=_LISTED,
            )

    return run


def _first(listed: DataFrame, k: int) -> DataFrame:
    """The first `k` of each anchor's goal over all tasks, with their rank."""
    order = Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return listed.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


OUT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    block: int = BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector of whole numbers).

    An anchor's positives are its `positives` highest-scoring rows of the same label with another vec_id. For each, the
    first `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive. Ties go to the smaller
    vec_id, a missing one last. Repeated rows count once: a list names a vec_id once for each score. Rows that share
    a vec_id but not the vector are rows of their own. Shorter vectors are taken to end in zeros. Scores beyond
    2^53 / 100 are refused, as they would not be exact. No anchors, no rows.
    """
    spark = rows.sparkSession
    about = rows.agg(
        F.count("*"), F.max(F.size("vector")), F.max(F.greatest(F.abs(F.array_max("vector")), F.abs(F.array_min("vector")))),
    ).first()
    n, width, most = about[0], about[1] or 0, about[2] or 0
    if 100 * width * most * most >= EXACT:
        raise ValueError(f"scores of {width} components up to {most} are not exact in 53 bits")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_ROWS))
    tiled = stage(rows.repartitionByRange(parts, "label", F.get("vector", F.lit(0)), "vec_id"), "tiles")
    asked = stage(tiled.filter(anchors).select("vec_id", "label", "vector").distinct(), "anchors")
    blocks = math.ceil(asked.count() / block)
    found = []
    for number in range(blocks):
        # one block at a time passes the driver
        own = asked.filter(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == number).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, labels = own.column("vec_id").to_numpy(), own.column("label").to_numpy()
        vectors = matrix(own.column("vector").combine_chunks(), width)
        every = [(np.array([-np.inf]), np.array([np.inf])) for _ in ids]
        shared = spark.sparkContext.broadcast(Anchors(ids, labels, vectors, every, positives, True))
        best = stage(_first(tiled.mapInArrow(_searched(shared, width), LISTED), positives), "positives")
        # positives with one score share a window
        scored = best.select("anchor", "score").distinct().toArrow()
        order = np.lexsort((-scored.column("score").to_numpy(), scored.column("anchor").to_numpy()))
        anchor, score = scored.column("anchor").to_numpy()[order], scored.column("score").to_numpy()[order]
        at = np.searchsorted(anchor, np.arange(len(ids) + 1))
        windows = [(-(-low * score[a:b] // 100), high * score[a:b] // 100) for a, b in zip(at, at[1:])]
        shared = spark.sparkContext.broadcast(Anchors(ids, labels, vectors, windows, negatives, False))
        worst = _first(tiled.mapInArrow(_searched(shared, width), LISTED), negatives).select(
            "anchor", "goal", "rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id")
        )
        goal = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.col("score").desc())) - 1
        wanted = best.select("anchor", goal.alias("goal"), F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id"))
        named = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(ids), dtype=np.int32)), "anchor_id": pa.array(ids)}))
        mined = wanted.join(worst, ["anchor", "goal"]).join(named, "anchor").select(*OUT)
        found.append(stage(mined, "negatives") if blocks > 1 else mined)
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return total


SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""

"""Filter interaction audit by contractions of contingency tensors.

A part's documents are counted by which of the filters they fail: a tensor with one axis of two
(pass, fail) for each filter. Whatever a sequence of filters does to the part is a contraction of
that tensor in which every axis is taken at pass, at fail, or summed over. So all orders of all
filters cost nothing beyond one pass over the documents: the texts are read once, each task
counts its own rows, and only the counts are contracted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import text_column

FILTERS = "ABCDE"
SPACE = "[\\x20\\x09-\\x0D]+"
PICK = {"pass": np.array([1, 0]), "fail": np.array([0, 1]), "all": np.array([1, 1])}
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AT_ONCE = 256  # parts whose rows are made at once


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, over a column `words` of its words."""
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic, n): how many rows of `docs` fail which filters.

    A missing text is empty, a missing source the empty part. E fails where a smaller doc_id has the same
    text (by SHA-256), whatever its part; rows without doc_id have no smaller one and are none. Rows that
    share the smallest doc_id of a text all pass E. A document is good (toxic) if any row of `labels` with
    its doc_id says so; rows without doc_id are neither.

    Rows are counted by text, doc_id and part before any join, and no join has a text alone as its
    key, so neither copies nor repeated rows load one task.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_column().alias("text")
    ).withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    flags = text_failures(text)
    counted = (
        rows.select("doc_id", "part", F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(name) for name, c in flags.items()])
        .groupBy("digest", "doc_id", "part", *flags).agg(F.count("*").alias("n"))
    )
    firsts = counted.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null").withColumn("first", F.lit(True))
    seen = counted.join(firsts, ["digest", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    known = (
        labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
        .withColumn("_salt", F.lit(0))
    )
    # rows without doc_id match nothing; the second key spreads them
    salt = F.when(F.col("doc_id").isNull(), F.hash("digest")).otherwise(0)
    marked = seen.withColumn("_key", salt).join(known, (F.col("doc_id") == F.col("_doc")) & (F.col("_key") == F.col("_salt")), "left")
    each = [F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return marked.select("part", *FILTERS, *each, "n")


def tensors(counted: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """(part, cells): for each part its cells (cell, n, good, toxic), at most 2^k of them. The cell's binary digits,
    first filter first, say which filters fail."""
    cell = F.lit(0)
    for name in filters:
        cell = cell * 2 + F.col(name).cast("int")
    cells = counted.groupBy("part", cell.alias("cell")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    )
    return cells.groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))


class Contraction:
    """A stack of tensors, one a part; contractions that several orders share are made once."""

    def __init__(self, stacked: np.ndarray):
        axes = stacked.ndim - 1
        letters = "abcdefghijklmno"[:axes]
        self.stacked, self.axes, self.made = stacked, axes, {}
        self.form = f"p{letters},{','.join(letters)}->p"

    def __call__(self, passing: Sequence[int] = (), failing: Sequence[int] = ()) -> np.ndarray:
        """Documents that pass the one filters and fail the others, whatever the rest say."""
        picks = ["all"] * self.axes
        for i in passing:
            picks[i] = "pass"
        for i in failing:
            picks[i] = "fail"
        key = tuple(picks)
        if key not in self.made:
            self.made[key] = np.einsum(self.form, self.stacked, *[PICK[p] for p in picks])
        return self.made[key]


def audited(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for stacks of tensors, each of shape (parts, orders, steps)."""
    every, of_good, of_toxic = Contraction(n), Contraction(good), Contraction(toxic)
    k = n.ndim - 1
    orders = list(itertools.permutations(range(k)))
    found = {name: np.zeros((len(n), len(orders), k), np.int64) for name in COUNTS}
    shares = np.zeros((len(n), k), np.int64)
    for o, order in enumerate(orders):
        for step, f in enumerate(order):
            earlier, others = order[:step], [i for i in range(k) if i != f]
            removed = every(earlier, [f])
            shares[:, f] += removed
            for name, value in (
                ("kept", every(order[: step + 1])), ("removed", removed), ("redundant", every((), [f]) - removed),
                ("unique_fails", every(others, [f])), ("good_lost", of_good(earlier, [f])), ("toxic_lost", of_toxic(earlier, [f])),
            ):
                found[name][:, o, step] = value
    found["shapley"] = shares[:, np.array(orders)]
    return found


def _orders(filters: Sequence[str]):
    k = len(filters)
    orders = ["".join(x) for x in itertools.permutations(filters)]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                lists, rows = part.column("cells"), part.num_rows
                flat = lists.flatten()
                of = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
                at = of, flat.field("cell").to_numpy()
                stacks = []
                for name in ("n", "good", "toxic"):
                    cells = np.zeros((rows, 2**k), np.int64)
                    cells[at] = flat.field(name).to_numpy()
                    stacks.append(cells.reshape(rows, *[2] * k))
                found = audited(*stacks)
                columns = {
                    "part": part.column("part").take(pa.array(np.repeat(np.arange(rows), len(orders) * k))),
                    "filter_order": pa.array(orders).take(pa.array(np.tile(np.repeat(np.arange(len(orders)), k), rows))),
                    "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows * len(orders))),
                    **{name: pa.array(values.ravel()) for name, values in found.items()},
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def interactions(counted: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, with COUNTS. `counted`: (part, one boolean a filter, true where
    it fails, good, toxic, n), as `failures` gives it. k filters have k! orders, so at most seven are taken."""
    if not 1 <= len(filters) <= 7:
        raise ValueError(f"{len(filters)} filters have {math.factorial(len(filters))} orders")
    counts = ", ".join(f"{name} long" for name in COUNTS)
    return tensors(counted, filters).mapInArrow(_orders(filters), f"part string, filter_order string, step int, {counts}")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters A to E in each source of `docs`. An empty table has no parts."""
    return interactions(failures(docs, labels))


SQL = """
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 200 AS A, 100 * len(list_distinct(words)) < 50 * len(words) AS B,
    100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
    coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false) AS E FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, [A::INT, B::INT, C::INT, D::INT, E::INT] AS fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s, o[s] AS filter, o[1:s - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), counted AS (
  SELECT part, o, s, filter,
    sum(CASE WHEN list_sum(list_transform(earlier, lambda i: fails[i])) > 0 OR fails[filter] = 1 THEN 0 ELSE n END) AS kept,
    sum(CASE WHEN coalesce(list_sum(list_transform(earlier, lambda i: fails[i])), 0) = 0 AND fails[filter] = 1 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_sum(list_transform(earlier, lambda i: fails[i])) > 0 AND fails[filter] = 1 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN list_sum(fails) = 1 AND fails[filter] = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN coalesce(list_sum(list_transform(earlier, lambda i: fails[i])), 0) = 0 AND fails[filter] = 1 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN coalesce(list_sum(list_transform(earlier, lambda i: fails[i])), 0) = 0 AND fails[filter] = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, s, filter
)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM counted
"""

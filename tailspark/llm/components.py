"""Connected components of an edge table, by rounds of hashed minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import stage


def _minima(pairs: DataFrame) -> DataFrame:
    """For each u of (u, v): the least of u and its v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_minima(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down)
    return down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum((h % 1_000_003).cast("long")), F.sum((h % 998_244_353).cast("long"))).first()
    return tuple(row)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """`u`, `v` edges to (`node`, `component`), the component's least node.

    Alternating large and small stars: each round is two aggregations with map-side
    combine and two joins that Spark can split on a hot node. The number of rounds grows
    with the logarithm of the graph; each round is written to the shared folder. Loops and
    rows with a missing end count for nothing. Only nodes with an edge come out.
    """
    edges = stage(edges.filter("u != v").select("u", "v").distinct(), label)
    mark = None
    while True:
        edges = stage(_small_star(_large_star(edges)).filter("u != v").distinct(), label)
        now = _mark(edges)
        if now == mark or now[0] == 0:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

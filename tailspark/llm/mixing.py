"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the words by its weight, at most `most` times its own size. Within a
source a document's expected number of copies rises with its size class (powers of two) and is
at most `most`; the whole part of that number is certain, the rest is an inclusion probability.
Documents are ranked by u / (1 - u) divided by p / (1 - p), u being a fixed pseudo-random number
of the document, and the lowest are taken until the source's target is met as nearly as whole
documents allow. So short scraps repeat less often, and a rerun takes the same documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.llm.common import bounds_of, fresh, stage, text_column, with_bucket

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, "mix"
SLICE_ROWS, MOST_SLICES = 20_000, 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, size) to (source, source_size, target); one row a source.

    Sources by code point, a missing one last, have the weights in turn. A target stops at `most`
    times its source's size; what that leaves over goes to the others by weight. So all sources
    below their stop share one rate, words for a unit of weight; it is found in one pass over
    the sources in the order in which they reach their stops.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy(F.col("stop") / F.col("w"), "rank")
    every = Window.partitionBy()
    source = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(named)).withColumn("w", w)
        .withColumn("stop", most * F.col("source_size"))
        .withColumn("before", F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(every) - F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rate", (share * F.sum("source_size").over(every) - F.col("before")) / F.col("open"))
        .withColumn("rate", F.min(F.when(F.col("rate") * F.col("w") <= F.col("stop"), F.struct(F.col("stop") / F.col("w"), "rank", "rate"))).over(every)["rate"])
    )
    found = F.when(F.col("rate").isNull(), F.col("stop")).otherwise(F.least("stop", F.col("rate") * F.col("w")))
    return source.select("source", "source_size", found.alias("target"))


def _class(size: Column) -> Column:
    """Number of binary digits of size + 1, less one: 0 for 0, 1 for 1-2, 2 for 3-6, ..."""
    return F.length(F.bin(size + 1)) - 1


def _rates(rows: DataFrame, per_source: DataFrame, most: float) -> DataFrame:
    """(source, class, copies): expected copies of a document, so that a source's sum is its target.

    copies = min(most, rate * (class + 1)), the rate found over the at most 64 classes of a
    source, from the largest class, which stops first.
    """
    by = Window.partitionBy("source")
    order = by.orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    weight = F.col("class") + F.lit(1.0)
    classes = (
        rows.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words"))
        .join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("before", F.coalesce(F.sum(most * F.col("words")).over(order), F.lit(0.0)))
        .withColumn("open", F.sum(F.col("words") * weight).over(by) - F.coalesce(F.sum(F.col("words") * weight).over(order), F.lit(0.0)))
        .withColumn("rate", (F.col("target") - F.col("before")) / F.nullif("open", F.lit(0.0)))
        .withColumn("fits", F.when(F.col("rate") * weight <= most, F.struct(-F.col("class"), "rate")))
        .withColumn("rate", F.min("fits").over(by)["rate"])
    )
    copies = F.when(F.col("rate").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.col("rate") * weight))
    return classes.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.greatest(copies, F.lit(0.0)).alias("copies"), "target", "source_size")


def uniform(seed: str, key: Column) -> Column:
    """A fixed number in (0, 1) for a key: 48 bits of its MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def copies_of(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(doc_id, version, size, source, source_size, target, copies, taken_copies) for each row of `docs`.

    size is the number of words between ASCII white space, 0 for a missing text; version is
    xxhash64 of the text. Missing sources are one source. Rows without doc_id are drawn by their
    text; equal rows share their number and stand in for each other. Documents of size 0 and
    sources without words take nothing.
    """
    text = text_column()
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(text).alias("digest"),
        ).withColumn("class", _class(F.col("size"))),
        "sizes",
    )
    per_source = stage(targets(rows, weights, share, most), "targets").withColumnRenamed("source", "_source")
    rates = stage(_rates(rows, per_source, most), "rates")
    drawn = (
        rows.join(rates, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")))
        .drop("_source", "_class")
        .withColumn("sure", F.floor("copies").cast("long"))
        .withColumn("p", F.col("copies") - F.col("sure"))
    )
    u = uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.col("digest")))
    odds = (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p")))
    open_ = F.col("p") > 0
    drawn = stage(drawn.withColumn("rank", F.when(open_ & (F.col("size") > 0), odds)), "drawn")

    # The ranks of a source are summed slice by slice; slices are cut by quantiles of the rank.
    open_rows = drawn.filter("rank is not null")
    slices = min(MOST_SLICES, max(1, math.ceil(open_rows.count() / SLICE_ROWS)))
    asked = with_bucket(open_rows, "rank", bounds_of(open_rows, "rank", slices), "slice")
    per_slice = asked.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = per_slice.select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    )
    sure = drawn.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("size") * F.col("sure")).alias("sure_words"))
    within = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        asked.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))).drop("_source", "_slice")
        .join(sure, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    )
    # a document is taken if the words before it leave room for at least half of it
    room = F.col("target") - F.col("sure_words") - F.col("before") - F.col("inside")
    extra = (2 * room >= F.col("size")).cast("long")
    columns = ["doc_id", "version", "size", "source", "source_size", "target", "copies"]
    return ranked.select(*columns, (F.col("sure") + extra).alias("taken_copies")).unionByName(
        drawn.filter("rank is null").select(*columns, F.when(F.col("size") > 0, F.col("sure")).otherwise(0).alias("taken_copies"))
    )


def _numbered(rows: DataFrame, group: list[str], name: str) -> DataFrame:
    """`rows`, written, with their number from 1 within their group, in any fixed order.

    A group may hold most rows: it is numbered file by file, and a file's numbers go on from those of the files before.
    """
    held = stage(rows, "repeats")
    file, row, before, file_ = fresh(rows, "file", "row", "before", "of_file")
    placed = held.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    earlier = Window.partitionBy(*group).orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    per_file = placed.groupBy(*group, file).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*group, file).orderBy(row))
    keys = fresh(placed, *[f"key{i}" for i in range(len(group))])
    per_file = per_file.toDF(*keys, file_, before)
    same = F.col(file) == F.col(file_)
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    return placed.withColumn(name, own).join(per_file, same).withColumn(name, F.col(name) + F.col(before)).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The rows of `docs` as often as the mix takes them; all columns stay.

    Rows that share doc_id, text and source are taken alike as far as their number of copies divides; the first of them
    (in any fixed order) get one more, so a source's words are those of `copies_of`.
    """
    doc, version, source, times, extra, number, each = fresh(docs, "doc", "version", "source", "times", "extra", "number", "each")
    groups = stage(
        copies_of(docs, weights, share, most, seed).groupBy(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("source").alias(source))
        .agg(F.floor(F.sum("taken_copies") / F.count("*")).cast("int").alias(times), (F.sum("taken_copies") % F.count("*")).alias(extra)),
        "copies",
    )
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text_column()) == F.col(version))
        & F.col("source").cast("string").eqNullSafe(F.col(source))
    )

    def repeated(rows: DataFrame) -> DataFrame:
        again = rows.filter(F.col(times) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times))))
        return again.select(*[F.col(f"`{c}`") for c in docs.columns])

    even = repeated(docs.join(groups.filter(F.col(extra) == 0), same))
    uneven = groups.filter(F.col(extra) > 0)  # only groups of several rows that the end of a source's room divides
    if uneven.isEmpty():
        return even
    numbered = _numbered(docs.join(uneven, same), [doc, version, source], number)
    more = (F.col(number) <= F.col(extra)).cast("int")
    return even.unionByName(repeated(numbered.withColumn(times, F.col(times) + more)))


SQL = f"""
WITH rows_ AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents
), classed AS (
  SELECT *, length(bin(size + 1)) - 1 AS class FROM rows_
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM classed GROUP BY source
), s1 AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((rank - 1) % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS stop FROM s
), s2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(stop) OVER (ORDER BY stop / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM s1
), s3 AS (
  SELECT source, source_size, least(stop, w * (SELECT arg_min(rate, (stop / w, rank)) FROM s2 WHERE rate * w <= stop)) AS target FROM s2
), c AS (
  SELECT k.source, k.class, k.words, s3.target, s3.source_size, k.class + 1.0::DOUBLE AS weight
  FROM (SELECT source, class, sum(size)::DOUBLE AS words FROM classed GROUP BY source, class) k JOIN s3 ON k.source IS NOT DISTINCT FROM s3.source
), c1 AS (
  SELECT *, (target - coalesce(sum(2.0::DOUBLE * words) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * weight) OVER (PARTITION BY source)
      - coalesce(sum(words * weight) OVER (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rate FROM c
), c2 AS (
  SELECT source, arg_max(rate, class) AS rate FROM c1 WHERE rate * weight <= 2.0::DOUBLE GROUP BY source
), c3 AS (
  SELECT c.*, greatest(least(2.0::DOUBLE, coalesce(c2.rate * c.weight, 2.0::DOUBLE)), 0) AS copies FROM c LEFT JOIN c2 ON c.source IS NOT DISTINCT FROM c2.source
), d AS (
  SELECT r.*, c3.target, c3.source_size, floor(copies)::BIGINT AS sure, copies - floor(copies) AS p,
    (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, digest)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u
  FROM classed r JOIN c3 ON r.source IS NOT DISTINCT FROM c3.source AND r.class = c3.class
), e AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank,
    sum(size * sure) OVER (PARTITION BY source) AS sure_words FROM d
), f AS (
  SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e
)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN rank IS NOT NULL AND 2 * (target - sure_words - before) >= size THEN 1 ELSE 0 END))::BIGINT AS taken FROM f
"""

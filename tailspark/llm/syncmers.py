"""Document fingerprints from closed syncmers.

A run of `K` code points is an anchor (a closed syncmer) when the least of its inner runs of `S`
stands at its start or end. Whether a run is one depends on the run alone, so texts that share
a passage share its anchors. A fingerprint keeps, of a text's distinct anchors, the `KEEP` with
the smallest hashes and the place where each comes first; texts of fewer than `K` code points
are one anchor. Two fingerprints are compared on the smallest hashes of both: an anchor counts
as shared if both have it and its shift is the commonest one or near it. The likeness is Dice's: 1 for
equal texts, about the share of text that stayed in place for edited ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import bounds_of, buckets_for, fold, mix, text_column, with_bucket

K, S, KEEP = 8, 4, 128
SHIFT_SLACK = 32
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _runs(x: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` (a power of two), by doubling."""
    base, n = np.uint64(0x9E3779B97F4A7C15), 1
    while n < length:
        x = x[:-n] * base + x[n:]
        base, n = base * base, 2 * n
    return mix(x)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a text's code points."""
    x = points.astype(np.uint64) + np.uint64(1)
    if len(x) < k:
        return (np.zeros(1, np.int64), fold([np.array([len(x)], np.uint64), *x[:, None]], 5)) if len(x) else (
            np.empty(0, np.int64), np.empty(0, np.uint64)
        )
    with np.errstate(over="ignore"):
        inner, whole = _runs(x, s), _runs(x, k)
    width, least = k - s + 1, inner
    n = 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[: -(width - n)], least[width - n :])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    return at, whole[at]


def sketch(text: str, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` smallest distinct anchor hashes, rising, and where each comes first."""
    at, hashes = anchors(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    hashes, first = np.unique(hashes >> np.uint64(24), return_index=True)
    return hashes[:keep], at[first[:keep]]


def render(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Hash and place of each kept anchor, in hexadecimal, by place."""
    hashes, at = found
    return " ".join(f"{h:010x}@{p:x}" for p, h in sorted(zip(at.tolist(), hashes.tolist())))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], keep: int = KEEP) -> float:
    """Dice likeness of two sketches, 0 to 1; two empty texts are equal."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.union1d(a[0], b[0])[:keep]
    inside = both <= least[-1]
    shift = a[1][ia[inside]] - b[1][ib[inside]]
    if not len(shift):
        return 0.0
    values, counts = np.unique(shift, return_counts=True)
    main = values[counts == counts.max()]
    main = main[np.argmin(np.abs(main))]
    shared = int((np.abs(shift - main) <= SHIFT_SLACK).sum())
    j = shared / len(least)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the text's code points replaced by as many of the next text's."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _rows():
    def run(batches):
        """Rows come sorted: by range from the last to the first, within it by falling doc_id; each range
        ends with the head of the range that follows in that order."""
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        held, held_sketch, bucket = None, None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("_bucket", "doc_id", "text")]
            for group, doc, text in zip(*columns):
                own = sketch(text)
                if held is not None and group == bucket:
                    changed = edited(held[1], text)
                    new = sketch(changed)
                    out.append((
                        held[0], len(held[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                        render(held_sketch), render(new), likeness(held_sketch, new), likeness(held_sketch, own),
                    ))
                held, held_sketch, bucket = (doc, text), own, group
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ]
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, ...), see SCHEMA.

    The next document is the one with the next smaller doc_id, after the last the first; rows that
    share a doc_id follow each other by text, rows without doc_id come last. A missing text is
    empty. A table of one row is its own next. Other columns are ignored.

    The order is cut into ranges of doc_id (a fixed multiple of the shuffle partitions); a range
    also gets the first row of the range after it, so each is worked through on its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    bounds = bounds_of(rows, "doc_id", buckets_for(rows))
    ranged = with_bucket(rows, "doc_id", bounds)
    # in falling order range 9 is followed by range 8 ..., the last by the first; one head a range
    heads = sorted(
        (r["_bucket"], r["top"]) for r in ranged.groupBy("_bucket").agg(F.max("doc_id").alias("top")).collect()
    )
    if not heads:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    before = {b: heads[(i + 1) % len(heads)][0] for i, (b, _) in enumerate(heads)}
    spark = docs.sparkSession
    table = spark.createDataFrame([(b, t, before[b]) for b, t in heads], "_bucket int, top long, to int")
    head_rows = rows.join(
        F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("top"))
    ).groupBy("to", "top").agg(F.max("text").alias("text"))
    tails = head_rows.select(F.col("top").alias("doc_id"), "text", F.col("to").alias("_bucket"), F.lit(1).alias("_tail"))
    both = ranged.withColumn("_tail", F.lit(0)).unionByName(tails)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, "_bucket").sortWithinPartitions(
        "_bucket", "_tail", F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )
    return ordered.mapInArrow(_rows(), SCHEMA)

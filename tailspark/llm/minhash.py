"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers make all signature coordinates: the first scatters a
document's shingles, the second, shifted circularly by k, orders them for coordinate k. A band
hashes `ROWS` coordinates. With 32 bands of 5 a pair with a Jaccard similarity of exactly 0.8
shares no band with probability 3e-6, one of 0.85 with 2e-8.

Texts with equal shingle sets form one class, so copies cost one row. The classes of a bucket
are compared with its smallest and its largest class, not with each other; classes that this
joins need no further comparison. A bucket that then still holds several components is cut into
blocks of about `BLOCK_ROWS` classes, and pairs of blocks are compared by matrix products, which
give all exact intersections at once; only links come out. So no bucket link is lost, and no
table of pairs is ever made. All comparisons are exact, on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailspark.llm.common import (
    chunks, ends, fold, let_go, split_words, stage, text_column, word_hashes,
)
from tailspark.llm.components import components

BANDS, ROWS = 32, 5
BLOCK_ROWS = 256
_BLOCK, _COLUMNS = 1 << 14, 1 << 12


def _scatter(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the least pi(sigma(x) + k) over all shingles x."""
    first = _scatter((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    out = np.full(size, np.uint32(0xFFFFFFFF))
    for i in range(0, len(first), _BLOCK):
        moved = first[None, i : i + _BLOCK] + shifts
        np.minimum(out, _scatter(moved, 0x7FEB352D, 0x846CA68B).min(axis=1), out=out)
    return out


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of `words` lower-cased words; a shorter text is one run."""
    import pyarrow.compute as pc

    flat, counts = split_words(pc.ascii_lower(texts))
    hashes, at = word_hashes(flat), ends(counts)
    n = max(0, len(hashes) - words + 1)
    runs = fold([hashes[j : j + n] for j in range(words)], words) if n else np.empty(0, np.uint64)
    out = []
    for i, count in enumerate(counts):
        if count >= words:
            out.append(np.unique(runs[at[i] : at[i + 1] - words + 1]))
        elif count:
            short = hashes[at[i] : at[i + 1]]
            out.append(fold([short[j : j + 1] for j in range(count)], 1000 + int(count)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(
        pa.array(ends(np.array([len(a) for a in arrays], np.int64)).astype(np.int32)), pa.array(flat.view(np.int64))
    )


def _signed(words: int, bands: int, rows: int):
    def run(batches):
        let_go()
        for batch in batches:
            for part in chunks(batch):
                sets = shingle_sets(part.column("text"), words)
                keys = []
                for s in sets:
                    if len(s):
                        parts = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                        keys.append(fold([np.arange(bands, dtype=np.uint64), *parts.T], 7))
                    else:
                        keys.append(np.empty(0, np.uint64))
                digests = [fold([s], 11) for s in sets]
                key = np.array([[d.sum(dtype=np.uint64), np.bitwise_xor.reduce(d)] if len(d) else [0, 0] for d in digests], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(np.array([len(s) for s in sets], np.int64)),
                        pa.array(key[:, 0].view(np.int64) if len(sets) else []),
                        pa.array(key[:, 1].view(np.int64) if len(sets) else []),
                        _lists(keys),
                    ],
                    names=["doc_id", "text_hash", "n", "k1", "k2", "bands"],
                )

    return run


def _sets(words: int):
    def run(batches):
        let_go()
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("cid"), _lists(shingle_sets(part.column("text"), words))], names=["cid", "shingles"]
                )

    return run


def _side(members: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one row's members: ids, components, sizes and the flat shingles."""
    sets = members.field("shingles")
    offsets = sets.offsets.to_numpy().astype(np.int64)
    return (
        members.field("cid").to_numpy(),
        members.field("component").to_numpy(),
        np.diff(offsets),
        sets.values.to_numpy()[offsets[0] : offsets[-1]],
    )


def intersections(left: np.ndarray, left_sizes: np.ndarray, right: np.ndarray, right_sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, as products of 0/1 matrices."""
    common = np.intersect1d(left, right)
    sides = []
    for flat, sizes in ((left, left_sizes), (right, right_sizes)):
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(common, flat)
        hit = common[np.minimum(at, len(common) - 1)] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((row[hit][order], at[hit][order], len(sizes)))
    out = np.zeros((len(left_sizes), len(right_sizes)), np.float32)
    for start in range(0, len(common), _COLUMNS):
        width = min(_COLUMNS, len(common) - start)
        parts = []
        for row, at, n in sides:
            a, b = np.searchsorted(at, [start, start + width])
            part = np.zeros((n, width), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _compared(percent: int):
    def run(batches):
        for batch in batches:
            us, vs = [], []
            for i in range(batch.num_rows):
                left = _side(batch.column("left").slice(i, 1).flatten())
                right = _side(batch.column("right").slice(i, 1).flatten()) if batch.column("right")[i].is_valid else left
                both = intersections(left[3], left[2], right[3], right[2])
                either = left[2][:, None] + right[2][None, :] - both
                a, b = np.nonzero((100 * both >= percent * either) & (left[1][:, None] != right[1][None, :]))
                us.append(np.minimum(left[0][a], right[0][b]))
                vs.append(np.maximum(left[0][a], right[0][b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (us, vs)], names=["u", "v"]
            )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) pairs whose whole sets are similar enough."""
    left = sets.select(F.col("cid").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("cid").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return (
        pairs.select("u", "v").join(right, "v").join(left, "u")
        .select("u", "v", both.alias("i"), (F.size("su") + F.size("sv") - both).alias("o"))
        .filter(100 * F.col("i") >= percent * F.col("o"))
        .select("u", "v")
    )


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) of each row of `docs` (doc_id, text, ...).

    Texts are linked when 100 * intersection >= percent * union of their sets of `words`-word
    shingles (A-Z lower-cased, words between ASCII white space). component_id is the smallest
    doc_id that links lead to. A missing or empty text has no shingle and no link. A row without
    doc_id takes part in nothing: its component_id is null. Rows that share a doc_id are texts of
    one document, so they belong together; text_hash, xxhash64 of the text, tells them apart.
    Other columns are ignored, whatever their names.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    signed = stage(
        plain.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
            _signed(words, bands, rows),
            "doc_id long, text_hash long, n long, k1 long, k2 long, bands array<long>",
        ),
        "minhash",
    )
    members = signed.filter("doc_id is not null and n > 0")
    classes = stage(
        members.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("cid"), F.first("bands").alias("bands")), "classes"
    )
    assigned = stage(
        signed.drop("bands").join(classes.drop("bands"), ["k1", "k2", "n"], "left").select("doc_id", "text_hash", "n", "cid"),
        "assigned",
    )
    several = assigned.groupBy("doc_id").agg(F.min("cid").alias("u"), F.max("cid").alias("v")).filter("u != v")
    own = several.drop("v").join(assigned, "doc_id").select("u", F.col("cid").alias("v"))

    in_bands = classes.select("cid", "n", F.explode("bands").alias("key"))
    busy = in_bands.groupBy("key").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).filter("low != high")
    met = stage(in_bands.join(busy, "key").select("key", "cid", "n", "low", "high"), "buckets")
    star = stage(
        met.select(F.col("low").alias("u"), F.col("cid").alias("v"))
        .union(met.select(F.col("cid").alias("u"), F.col("high").alias("v")))
        .filter("u != v")
        .distinct(),
        "star",
    )
    wanted = met.select("cid").distinct()
    sets = stage(
        plain.join(wanted, F.col("doc_id") == F.col("cid")).select("cid", "text").mapInArrow(
            _sets(words), "cid long, shingles array<long>"
        ),
        "sets",
    )
    edges = stage(_linked(star, sets, percent).union(own), "links")
    found = components(edges)

    # buckets that the stars left in several components; of buckets with the same classes one will do
    placed = stage(
        met.select("key", "cid").join(found, F.col("cid") == F.col("node"), "left")
        .select("key", "cid", F.coalesce("component", "cid").alias("component")),
        "placed",
    )
    mixed = (
        placed.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"),
            F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("y"),
        )
        .filter("low != high")
        .groupBy("m", "x", "y").agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    )
    mixed = stage(mixed, "mixed")
    blocks = stage(
        placed.join(mixed, "key")
        .select("key", "cid", "component", F.pmod(F.xxhash64(F.lit(2), "cid"), "blocks").cast("int").alias("block"))
        .join(sets, "cid")
        .groupBy("key", "block").agg(F.collect_list(F.struct("cid", "component", "shingles")).alias("members")),
        "blocks",
    )
    block_pairs = mixed.select("key", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a")).select(
        "key", "a", F.explode(F.sequence("a", F.col("blocks") - 1)).alias("b")
    )
    sides = (
        block_pairs.join(blocks.select("key", F.col("block").alias("a"), F.col("members").alias("left")), ["key", "a"])
        .withColumn("other", F.when(F.col("a") != F.col("b"), F.col("b")))
        .join(
            blocks.select(F.col("key").alias("_key"), F.col("block").alias("other_block"), F.col("members").alias("right")),
            (F.col("key") == F.col("_key")) & (F.col("other") == F.col("other_block")),
            "left",
        )
        .filter("other is null or right is not null")
        .select("left", "right")
    )
    rest = stage(sides.mapInArrow(_compared(percent), "u long, v long").distinct(), "rest")
    if not rest.isEmpty():
        found = components(edges.union(rest))
    return assigned.join(found, F.col("cid") == F.col("node"), "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "cid", "doc_id").alias("component_id"),
    )


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay: one document of each group, the one with the smallest doc_id.

    All columns stay. Rows without text or doc_id stay; of rows with one doc_id one stays.
    """
    verdict = near_duplicates(docs, words, percent)
    kept = verdict.filter("doc_id = component_id").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")
    ).groupBy("_id").agg(F.min("_text").alias("_text"))
    same = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64(text_column()) == F.col("_text"))
    named = docs.filter("doc_id is not null").join(kept, same, "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))

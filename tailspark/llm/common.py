"""Helpers that several operators share."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.staging import stage

__all__ = [
    "bounds_of", "buckets_for", "chunks", "documents", "ends", "fold", "fresh", "kept_between_tasks", "let_go", "mix", "split_words", "stage", "tagged",
    "text_column", "word_hashes", "with_bucket",
]

MIX = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_column(name: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have yet, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        new = f"_{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        found.append(new)
    return found


# --- order without a single task ---------------------------------------------------


def buckets_for(df: DataFrame, per_partition: int = 4) -> int:
    """Ranges to cut an order into: a fixed multiple of the session's shuffle partitions."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def bounds_of(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Rising cut values that split `column` into about equal ranges; at most `buckets` - 1 numbers."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", shares, 1 / (4 * buckets))
    return sorted(set(cuts))


def with_bucket(df: DataFrame, column: str, bounds: list[float], name: str = "_bucket") -> DataFrame:
    """Number of the range, rising with `column`; missing values come before all others, in -1."""
    value = F.col(column).cast("double")
    if not bounds:
        return df.withColumn(name, F.when(value.isNull(), -1).otherwise(0))
    cut = Bucketizer(
        splits=[-float("inf"), *bounds, float("inf")], inputCol="_value", outputCol="_range", handleInvalid="keep"
    )
    ranged = cut.transform(df.withColumn("_value", value))
    number = F.when(F.col("_value").isNull(), -1).otherwise(F.col("_range").cast("int"))
    return ranged.withColumn(name, number).drop("_value", "_range")


# --- what a worker keeps between tasks ---------------------------------------------

_KEPT: list[dict] = []


def kept_between_tasks() -> dict:
    """A table that the tasks of one worker share."""
    table: dict = {}
    _KEPT.append(table)
    return table


def let_go() -> None:
    """Called by a task that needs none of the tables: a worker does not hold them through other stages."""
    if any(_KEPT):
        for table in _KEPT:
            table.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


# --- batches of texts --------------------------------------------------------------


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = 4_000_000):
    """Slices of a batch with about `size` bytes of text; a longer text comes alone."""
    texts = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, start = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, flat, and how many each text has; missing texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[offsets])


def ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fold(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One 64-bit hash for each row of several 64-bit columns."""
    h = np.full(len(parts[0]), np.uint64(seed) ^ MIX)
    for part in parts:
        h = mix(h * np.uint64(0x100000001B3) ^ part)
    return h


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words; each distinct word is hashed once."""
    if not len(words):
        return np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    known = np.fromiter(
        (xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()),
        np.uint64,
        len(coded.dictionary),
    )
    return known[coded.indices.to_numpy()]


def tagged(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])

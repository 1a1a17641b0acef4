"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.llm import (
    arrowfiles, decontamination, hardnegatives, interactions, licences, linedup, minhash, mixing, packing, perplexity, syncmers,
    tokencount, transcripts,
)
from tailspark.llm.common import documents
from tailspark.staging import staging_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


@register("op1_closed_syncmers")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, folder))


@register("op2_sum_of_squares")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


@register("op3_rank_synchronous")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(documents(spark, folder))


@register("op4_deletion_neighbourhood", linedup.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.line_report(documents(spark, folder)).withColumn("dropped", F.array_join("dropped", ","))


@register("op5_kneser_ney")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found, out = perplexity.judged(documents(spark, folder), keep=["doc_id"])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")
    return found.select("doc_id", *[F.col(f"{out}.{n}").alias(n) for n in names])


@register("op6_rare_token_index")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return licences.digest(licences.scan(documents(spark, folder)))


@register("op7_arrow_sequences")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return arrowfiles.round_trip(spark, documents(spark, folder), staging_path(spark, "sequences"))


@register("op8_circulant_minhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, folder), words=2)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


@register("op9_pareto_mix", mixing.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.copies_of(documents(spark, folder))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_copies")).alias("taken"))


@register("op10_hmm_transcripts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.parse(spark.read.parquet(f"{folder}/conversations.parquet"))


@register("op11_ngram_decontamination", decontamination.SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@register("op12_contingency_contractions", interactions.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@register("op13_str_rtree_negatives", hardnegatives.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(hardnegatives.quantised(rows.withColumn("label", moved)), F.col("vec_id") % 100 == 0)

"""Written intermediate tables.

A table that several later steps read is written once, as parquet, to the folder the
cluster names in `spark.checkpoint.dir`. That cuts lineage in storage that outlives any
executor, lets each reader prune columns, and gives the optimiser true sizes, so it
broadcasts a side only when that side is small. Where the setting is empty the session's
warehouse, which Spark shares by its nature, takes the tables; no machine-local temporary
folder is ever used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, order_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the staging folder and return a fresh scan of it.

    With `order_by` the files hold ranges of these columns in order, so a filter on the first of them skips
    files and row groups by their statistics.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

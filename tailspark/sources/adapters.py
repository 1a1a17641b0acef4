"""The five input tables of the model, derived from a TPC-H-like star schema.

A supplier stands for a stock: its daily volume-weighted line price is the price, the
share of returned lines in a month the controversy score, its region the sector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _ticker(key: str) -> Column:
    return F.concat(F.lit("S"), F.col(key).cast("string"))


def _unit_price() -> Column:
    """Whole cents add up to one sum in any order, so a rerun gives the same price to the last bit."""
    return F.sum(F.rint(F.col("l_extendedprice") * 100)) / 100 / F.sum("l_quantity")


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.to_date("l_shipdate").alias("date"))
        .agg(
            _unit_price().alias("adj_close"),
            F.sum("l_quantity").alias("volume"),
        )
        .select(_ticker("l_suppkey").alias("ticker"), "date", "adj_close", "volume")
    )


def benchmark_prices(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.to_date("l_shipdate").alias("date"))
        .agg(_unit_price().alias("benchmark_close"))
    )


def controversies(spark: SparkSession, folder: str) -> DataFrame:
    # lines shrink to supplier-months before the supplier's region is looked up
    monthly = (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", F.last_day("l_shipdate").alias("date"))
        .agg(
            (10 * F.avg((F.col("l_returnflag") == "R").cast("double"))).alias("controversy_score")
        )
    )
    suppliers = (
        table(spark, folder, "supplier")
        .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", F.col("r_name").alias("sector"))
    )
    return monthly.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _ticker("l_suppkey").alias("ticker"), "date", "sector", "controversy_score"
    )


def fundamentals_raw(spark: SparkSession, folder: str) -> DataFrame:
    # an order counts for the quarter that it falls in
    quarter_end = F.last_day(F.add_months(F.date_trunc("quarter", "o_orderdate"), 2))
    orders = table(spark, folder, "orders").withColumn("_quarter_end", quarter_end)
    quarterly = (
        table(spark, folder, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_suppkey", F.col("_quarter_end").alias("period_end"))
        .agg(
            F.sum("o_totalprice").alias("market_cap"),
            (1000.0 * F.count("*")).alias("shares_outstanding"),
            F.avg("o_totalprice").alias("_price"),
            F.avg("l_discount").alias("leverage"),
            F.avg("l_tax").alias("roa"),
        )
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return quarterly.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _ticker("l_suppkey").alias("ticker"),
        "period_end",
        "market_cap",
        "shares_outstanding",
        (F.col("_price") / F.nullif("s_acctbal", F.lit(0.0))).alias("market_to_book"),
        "leverage",
        "roa",
    )


def fundamentals(spark: SparkSession, folder: str, lag_days: int = 45) -> DataFrame:
    return fundamentals_raw(spark, folder).withColumn(
        "available_date", F.date_add("period_end", lag_days)
    )


def news_text(spark: SparkSession, folder: str) -> DataFrame:
    stocks = table(spark, folder, "supplier").agg(F.count("*")).scalar()
    return table(spark, folder, "documents").select(
        F.concat(F.lit("S"), (F.col("doc_id") % stocks).cast("string")).alias("ticker"),
        F.date_add(F.lit("1995-01-06").cast("date"), ((F.col("doc_id") * 37) % 2300).cast("int")).alias("date"),
        "source",
        "text",
        F.col("doc_id").alias("text_id"),
    )


def model_tables(spark: SparkSession, folder: str, lag_days: int = 45) -> dict[str, DataFrame]:
    return {
        "prices": prices(spark, folder),
        "benchmark_prices": benchmark_prices(spark, folder),
        "fundamentals": fundamentals(spark, folder, lag_days),
        "controversies": controversies(spark, folder),
    }

"""Write result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parquet_by_year(df: DataFrame, path: str, date: str = "date") -> None:
    """Large tables: parquet folders per year, so a date filter reads only its years.

    The rebalance hint lets AQE split a heavy year and merge light ones, so files come out
    evenly sized.
    """
    (
        df.withColumn("year", F.year(date))
        .hint("rebalance", F.col("year"))
        .sortWithinPartitions("ticker", date)
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A CSV folder, cells as they are and quotes doubled; one file only for results known to be small."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if single_file else df).write.mode("overwrite").options(header=True, **options).csv(path)


def json_ready(df: DataFrame) -> DataFrame:
    """NaN and infinities to null, which JSON can hold."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns(
        {
            c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c))
            for c in numbers
        }
    )


def write_json_records(df: DataFrame, path: str) -> None:
    json_ready(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_payload(tables: dict[str, DataFrame], folder: str) -> None:
    """All result tables, one JSON folder each."""
    for name, df in tables.items():
        write_json_records(df, f"{folder.rstrip('/')}/{name}")


def _as_text(df: DataFrame, field: T.StructField):
    column = F.col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        text = F.initcap(column.cast("string"))
    elif isinstance(field.dataType, T.DoubleType):
        # whole numbers without an exponent
        whole = (column == F.floor(column)) & (F.abs(column) >= 1e7) & (F.abs(column) < 1e15)
        # nor do sizes from 0.0001 on
        small = F.abs(column).between(1e-4, 1e-3)
        text = (
            F.when(whole, F.concat(column.cast("bigint").cast("string"), F.lit(".0")))
            .when(small, F.regexp_replace(column.cast("decimal(20,18)").cast("string"), "0+$", ""))
            .otherwise(column.cast("string"))
        )
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("None"))


def to_metric_rows(one_row: DataFrame) -> DataFrame:
    """A wide row as (metric, value) text rows."""
    pairs = [
        F.struct(F.lit(f.name).alias("metric"), _as_text(one_row, f).alias("value")) for f in one_row.schema
    ]
    return one_row.select(F.inline(F.array(*pairs)))

"""Exact ranks, quantiles and cuts for groups of any size, by one plan.

A ranking window would sort a whole group in one task. Here a group is spread over range
partitions ("slices"), ranked inside each, and shifted by the totals of the slices before it:

1. `repartitionByRange(keys, order)` cuts at sampled bounds, also inside one hot group;
2. the slice number is written down with the rows, so every later reader sees one and the
   same assignment, also after a lost executor;
3. totals per (group, slice) are summed up over the slices before, a table of at most
   groups + slices rows, and joined back.

So one date, sector or split may hold most rows, and ties collapse before any sort of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.staging import stage

def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Add, per entry of `sums`, the total over the rows before this one in its group.

    `order` must be total within a group for a repeatable result.
    """
    ranged = df.select(
        "*", *[value.alias(f"_value_{name}") for name, value in sums.items()]
    ).repartitionByRange(*[F.col(k) for k in keys], *order)
    sliced = stage(ranged.withColumn("_slice", F.spark_partition_id()), "slices")

    group = [*keys, "_slice"]
    totals = sliced.groupBy(*group).agg(
        *[F.sum(f"_value_{name}").alias(f"_total_{name}") for name in sums]
    )
    earlier_slices = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *group,
        *[
            F.coalesce(F.sum(f"_total_{name}").over(earlier_slices), F.lit(0)).alias(f"_offset_{name}")
            for name in sums
        ],
    )
    earlier_rows = (
        Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    within = sliced.select(
        *df.columns,
        "_slice",
        *[
            F.coalesce(F.sum(f"_value_{name}").over(earlier_rows), F.lit(0)).alias(f"_inside_{name}")
            for name in sums
        ],
    )
    return within.join(offsets, group).select(
        *df.columns,
        *[(F.col(f"_offset_{name}") + F.col(f"_inside_{name}")).alias(name) for name in sums],
    )


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """Row number within the group, from 1."""
    counted = running_totals(df, keys, order, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) + 1)


def with_position_and_size(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str,
    size: str,
) -> DataFrame:
    """Row number and row count of the group."""
    counted = running_totals(df, keys, order, {position: F.lit(1).cast("long")})
    sizes = df.groupBy(*keys).agg(F.count("*").alias(size))
    return counted.withColumn(position, F.col(position) + 1).join(sizes, list(keys))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value of a group; ties collapse before any sort."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_ties"))
    )


def _group_sizes(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_size"))


def attach_percentile(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank among ties over the group's non-null count; null for a null value."""
    x = F.col(value)
    counts = value_counts(df, keys, value)
    ranked = running_totals(counts, keys, [x.asc()], {"_before": F.col("_ties")})
    table = ranked.join(_group_sizes(df, keys, value), list(keys)).select(
        *keys, value, ((F.col("_before") + (F.col("_ties") + 1) / 2) / F.col("_size")).alias(name)
    )
    # rows without a value skip the join, where they would all meet under one null key
    valued = df.where(x.isNotNull()).join(table, [*keys, value]).select(*df.columns, name)
    return valued.unionByName(df.where(x.isNull()).withColumn(name, F.lit(None).cast("double")))


def group_quantile(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """(keys, name): the linearly interpolated quantile of each group's non-null values."""
    ranked = running_totals(
        value_counts(df, keys, value), keys, [F.col(value).asc()], {"_before": F.col("_ties")}
    )
    place = (F.col("_size") - 1) * F.lit(float(share))
    low, high = F.floor(place), F.ceil(place)
    upto = F.col("_before") + F.col("_ties")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_before") <= position) & (position < upto), F.col(value)))

    picked = (
        ranked.join(_group_sizes(df, keys, value), list(keys))
        .withColumns({"_place": place, "_low": low, "_high": high})
        # only the one or two values around the place go on to the last grouping
        .where((F.col("_before") <= F.col("_high")) & (upto > F.col("_low")))
        .groupBy(*keys)
        .agg(
            at(F.col("_low")).alias("_a"),
            at(F.col("_high")).alias("_b"),
            F.max(F.col("_place") - F.col("_low")).alias("_part"),
        )
    )
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias(name))


def with_risk_bucket(
    df: DataFrame,
    keys: Sequence[str] = ("date",),
    probability: str = "crash_probability",
    tie: Sequence[str] = ("ticker",),
    high_share: float = 0.20,
    medium_share: float = 0.40,
) -> DataFrame:
    """High / Medium / Low by rank within the group, highest probability first."""
    order = [F.col(probability).desc(), *[F.col(c).asc() for c in tie]]
    ranked = with_position_and_size(df, keys, order, "_position", "_size")
    high = F.greatest(F.lit(1), F.ceil(F.col("_size") * F.lit(float(high_share))))
    medium = F.greatest(F.lit(0), F.ceil(F.col("_size") * F.lit(float(medium_share))))
    bucket = (
        F.when(F.col("_position") <= high, "High")
        .when(F.col("_position") <= high + medium, "Medium")
        .otherwise("Low")
    )
    return ranked.withColumn("risk_bucket", bucket).drop("_position", "_size")

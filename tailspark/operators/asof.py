"""Backward as-of joins without a range join.

Right rows are first cut to one row per key and date, then both sides are unioned and the
newest right row up to each left row is carried forward by `last(struct, ignorenulls)`.
One shuffle on the key serves any number of right tables and nothing is multiplied.

Where the left side has a row per key and calendar date (the panel), a key's partition is bounded by
the calendar. Where it has any number of rows per key (events, trades), one key may hold most rows: then
`asof_attach_ranges` cuts both sides by ranges of (key, date), carries inside each range, and brings in from the
earlier ranges of a key the newest row of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.staging import stage


@dataclass(frozen=True)
class AsofSide:
    """A right table: the date it becomes known on, and the columns it brings.

    `snap` maps that date to the first date of the left grid that may see it (for a
    Friday panel, the Friday on or after); all but the newest row per grid date drop out
    before the shuffle.
    """

    table: DataFrame
    on: str
    columns: Sequence[str]
    snap: Callable[[Column], Column] | None = None


def asof_attach(left: DataFrame, sides: Sequence[AsofSide], by: str, on: str) -> DataFrame:
    """Attach to each left row the newest row of every side with side.on <= left.on.

    The whole newest row is taken, so a null inside it stays null. Of several rows with
    the same date the greatest by (date, columns in the given order) counts.
    """
    pieces = _pieces(left, sides, by, on)
    # side 0 sorts first, so a right row of the same date is already visible
    upto = (
        Window.partitionBy(by)
        .orderBy(on, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    carried = [F.last(name, ignorenulls=True).over(upto).alias(name) for name in _names(sides)]
    return _brought(pieces.select(*left.columns, "_side", *carried).where("_side = 1"), left, sides)


def asof_attach_ranges(left: DataFrame, sides: Sequence[AsofSide], by: str, on: str) -> DataFrame:
    """`asof_attach` for keys of any size: the same rows, one task a range of (key, date).

    The range of each row is written down, so all readers see one assignment. Left rows of one key and date
    may be split as well, since the right rows of a date stand before them. What the ranges before bring in is a
    prefix maximum by date over at most one row a key and range.
    """
    pieces = _pieces(left, sides, by, on)
    spread = F.when(F.col("_side") == 1, F.xxhash64(*left.columns))
    ranged = pieces.withColumn("_spread", spread).repartitionByRange(by, on, "_side", "_spread").drop("_spread")
    sliced = stage(ranged.withColumn("_range", F.spark_partition_id()), "asof")

    names, brought_in = _names(sides), [f"_in{name}" for name in _names(sides)]
    newest = [
        F.max(F.when(F.col(name).isNotNull(), F.struct(on, name))).alias(name) for name in names
    ]
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.where("_side = 0").groupBy(by, "_range").agg(*newest)
    # ranges of a key without right rows take part, as their left rows ask
    asked = sliced.where(F.col(by).isNotNull()).groupBy(by, "_range").agg(F.count_if(F.col("_side") == 1).alias("_asks"))
    carried_in = (
        asked.join(held, [by, "_range"], "left")
        .select(by, "_range", "_asks", *[F.max(name).over(before)[name].alias(new) for name, new in zip(names, brought_in)])
        .where("_asks > 0").drop("_asks")
    )
    upto = (
        Window.partitionBy(by, "_range")
        .orderBy(on, "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = [F.last(name, ignorenulls=True).over(upto).alias(name) for name in names]
    rows = sliced.select(*left.columns, "_side", "_range", *inside).where("_side = 1").join(carried_in, [by, "_range"], "left")
    known = rows.select(*left.columns, *[F.coalesce(name, new).alias(name) for name, new in zip(names, brought_in)])
    return _brought(known, left, sides)


def _names(sides: Sequence[AsofSide]) -> list[str]:
    return [f"_row{number}" for number in range(len(sides))]


def _pieces(left: DataFrame, sides: Sequence[AsofSide], by: str, on: str) -> DataFrame:
    """Left rows (_side 1) and of each right table one row a key and date (_side 0)."""
    pieces = left.withColumn("_side", F.lit(1))
    for number, side in enumerate(sides):
        seen_on = side.snap(F.col(side.on)) if side.snap else F.col(side.on)
        newest = (
            side.table.where(F.col(by).isNotNull() & F.col(side.on).isNotNull())
            .groupBy(F.col(by), seen_on.alias(on))
            .agg(F.max(F.struct(F.col(side.on).alias("_known"), *side.columns)).alias(f"_row{number}"))
            .withColumn("_side", F.lit(0))
        )
        pieces = pieces.unionByName(newest, allowMissingColumns=True)
    return pieces


def _brought(known: DataFrame, left: DataFrame, sides: Sequence[AsofSide]) -> DataFrame:
    brought = [
        F.col(f"_row{n}.{column}").alias(column)
        for n, side in enumerate(sides)
        for column in side.columns
    ]
    return known.select(*left.columns, *brought)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_on: str,
    right_on: str,
    columns: Sequence[str],
    snap: Callable[[Column], Column] | None = None,
    any_size: bool = False,
) -> DataFrame:
    """One right table. `any_size`: a key may hold any number of left rows, so cut by ranges."""
    attach = asof_attach_ranges if any_size else asof_attach
    return attach(left, [AsofSide(right, right_on, columns, snap)], by, left_on)

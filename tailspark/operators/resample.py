"""Daily rows to Friday weeks and to month ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def week_end(date: Column | str) -> Column:
    """The Friday on or after a date."""
    return F.next_day(F.date_sub(F.col(date) if isinstance(date, str) else date, 1), "FRI")


# Friday back to Saturday, as 0 = Monday; and the days of a month from the last.
_WEEKDAYS = (4, 3, 2, 1, 0, 6, 5)
_MONTH_DAYS = tuple(range(31, 0, -1))


def _daily_maxima(value: str, day: Column, days: tuple[int, ...]) -> list[Column]:
    # One maximum per day of the period. Buffers stay primitive, so the aggregation is a hash
    # aggregation with map-side combine, and a ticker with very many raw rows shrinks to one
    # row per period before the shuffle. Two rows on one day: the higher value counts.
    return [F.max(F.when(day == d, F.col(value))).alias(f"_{value}_{d}") for d in days]


def _newest(value: str, days: tuple[int, ...]) -> Column:
    """The last day's value that is not null; `days` runs from the newest."""
    return F.coalesce(*[F.col(f"_{value}_{d}") for d in days]).alias(value)


def weekly_prices(prices: DataFrame) -> DataFrame:
    """(ticker, date=Friday, adj_close, weekly_volume): last price, summed volume, no empty weeks."""
    grouped = prices.groupBy("ticker", week_end("date").alias("week")).agg(
        *_daily_maxima("adj_close", F.weekday("date"), _WEEKDAYS),
        F.coalesce(F.sum("volume"), F.lit(0.0)).alias("weekly_volume"),
    )
    return grouped.select(
        "ticker", F.col("week").alias("date"), _newest("adj_close", _WEEKDAYS), "weekly_volume"
    ).where(F.col("adj_close").isNotNull())


def change_from_previous(value: str, window) -> Column:
    """Fractional change from the previous row that exists; null after a zero."""
    return F.col(value) / F.nullif(F.lag(value, 1).over(window), F.lit(0.0)) - 1.0


def weekly_returns(prices: DataFrame) -> DataFrame:
    """Weekly prices with the change from the previous week that exists."""
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    return weekly_prices(prices).withColumn(
        "weekly_return", change_from_previous("adj_close", by_ticker)
    )


def weekly_benchmark(benchmark: DataFrame) -> DataFrame:
    """(date=Friday, benchmark_close, benchmark_return), one row per calendar week.

    The unpartitioned window runs on the weekly table only: about 52 rows a year.
    """
    grouped = benchmark.groupBy(week_end("date").alias("week")).agg(
        *_daily_maxima("benchmark_close", F.weekday("date"), _WEEKDAYS)
    )
    weekly = grouped.select(F.col("week").alias("date"), _newest("benchmark_close", _WEEKDAYS)).where(
        F.col("benchmark_close").isNotNull()
    )
    return weekly.withColumn(
        "benchmark_return", change_from_previous("benchmark_close", Window.orderBy("date"))
    )


def monthly_prices(prices: DataFrame) -> DataFrame:
    """(ticker, date=month end, adj_close): last price, months without rows kept as null."""
    last = (
        prices.where(F.col("adj_close").isNotNull())
        .groupBy("ticker", F.last_day("date").alias("month"))
        .agg(*_daily_maxima("adj_close", F.dayofmonth("date"), _MONTH_DAYS))
        .select("ticker", "month", _newest("adj_close", _MONTH_DAYS))
    )
    # Each row fills the gap up to the ticker's next month, so no calendar join is needed.
    next_month = F.lead("month").over(Window.partitionBy("ticker").orderBy("month"))
    gap = F.greatest(
        F.coalesce(F.months_between("_next", "month").cast("int") - 1, F.lit(0)), F.lit(0)
    )
    filled = last.withColumn("_next", next_month).withColumn(
        "date",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), gap), lambda step: F.last_day(F.add_months("month", step))
            )
        ),
    )
    return filled.select(
        "ticker", "date", F.when(F.col("date") == F.col("month"), F.col("adj_close")).alias("adj_close")
    )

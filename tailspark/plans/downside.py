"""A monthly signal of coming losses, used to time artificial controversy shocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailspark.operators.ranking import attach_percentile
from tailspark.operators.resample import monthly_prices
from tailspark.staging import stage


def forward_downside_signal(prices: DataFrame, months: int = 3) -> DataFrame:
    """Per ticker and month: next return and worst level, ranked by date and mixed 60 to 40."""
    by_ticker = Window.partitionBy("ticker").orderBy("date")
    s = F.col("adj_close")
    worst = F.min(s).over(by_ticker.rowsBetween(1, months))
    ahead = monthly_prices(prices).select(
        "ticker",
        "date",
        "adj_close",
        (F.lead("adj_close", months).over(by_ticker) / F.nullif(s, F.lit(0.0)) - 1.0).alias("future_return_3m"),
        F.when(F.lead("date", months - 1).over(by_ticker).isNotNull(), worst).alias("future_min_3m"),
    )
    measured = stage(
        ahead.withColumn(
            "future_drawdown_3m", F.col("future_min_3m") / F.nullif(s, F.lit(0.0)) - 1.0
        ).withColumns({"_loss": -F.col("future_return_3m"), "_fall": -F.col("future_drawdown_3m")}),
        "monthly",
    )
    by_loss = attach_percentile(measured, ["date"], "_loss", "loss_rank")
    ranked = attach_percentile(stage(by_loss, "loss"), ["date"], "_fall", "drawdown_rank")
    mix = 0.60 * F.col("loss_rank") + 0.40 * F.col("drawdown_rank")
    return (
        ranked.withColumn("future_downside_signal", F.least(F.greatest(mix, F.lit(0.0)), F.lit(1.0)))
        .where(F.col("loss_rank").isNotNull() & F.col("drawdown_rank").isNotNull())
        .drop("_loss", "_fall")
    )

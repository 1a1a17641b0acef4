"""The weekly feature panel as one lazy plan.

Shuffles: one per raw table to cut it to a row per ticker and week (with map-side
combine), then one on the ticker that the as-of joins and every rolling window share. A
ticker's partition is bounded by the number of calendar weeks, whatever its raw size.
The cross-sections (sector rank, label threshold) read the staged rows before the windows, a few narrow
columns each, so the wide rows are made behind the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailspark.config import Settings
from tailspark.functions import stats
from tailspark.operators.asof import AsofSide, asof_attach
from tailspark.operators.ranking import attach_percentile, group_quantile
from tailspark.operators.resample import (
    change_from_previous,
    week_end,
    weekly_benchmark,
    weekly_prices,
)
from tailspark.staging import stage

FUNDAMENTAL_COLUMNS = (
    "period_end",
    "available_date",
    "market_cap",
    "shares_outstanding",
    "market_to_book",
    "leverage",
    "roa",
)

def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def rolling(n: int):
    return by_ticker().rowsBetween(-(n - 1), Window.currentRow)


def forward(n: int):
    return by_ticker().rowsBetween(1, n)


def base_panel(tables: dict[str, DataFrame]) -> DataFrame:
    """Weekly rows with returns, fundamentals known by then and the latest controversy row."""
    weekly = weekly_prices(tables["prices"])
    known = asof_attach(
        weekly,
        [
            AsofSide(tables["fundamentals"], "available_date", FUNDAMENTAL_COLUMNS, snap=week_end),
            AsofSide(tables["controversies"], "date", ("sector", "controversy_score"), snap=week_end),
        ],
        by="ticker",
        on="date",
    )
    returns = known.withColumn("weekly_return", change_from_previous("adj_close", by_ticker()))
    # one row per calendar week, so this side is small at any data size
    market = F.broadcast(weekly_benchmark(tables["benchmark_prices"]).select("date", "benchmark_return"))
    return returns.join(market, "date", "left").select(
        "*",
        stats.finite(F.col("weekly_return") - F.col("benchmark_return")).alias("firm_specific_return"),
        (F.col("weekly_volume") / F.nullif("shares_outstanding", F.lit(0.0))).alias("turnover"),
    )


def with_rolling_features(base: DataFrame, settings: Settings, with_targets: bool = False) -> DataFrame:
    """Every rolling feature in one window pass over the ticker's weeks."""
    ret, market, firm = F.col("weekly_return"), F.col("benchmark_return"), F.col("firm_specific_return")
    score, turnover = F.col("controversy_score"), F.col("turnover")
    trailing, trade, betas = (
        rolling(settings.trailing_window),
        rolling(settings.turnover_window),
        rolling(settings.beta_window),
    )
    trailing_min = settings.min_periods(settings.trailing_window)
    trade_min = settings.min_periods(settings.turnover_window)
    beta_min = settings.min_periods(settings.beta_window)

    parts = [
        F.count(turnover).over(trade).alias("_t_n"),
        F.avg(turnover).over(trade).alias("_t_mean"),
        F.stddev_samp(turnover).over(trade).alias("_t_std"),
        F.count(ret).over(trailing).alias("_r_n"),
        stats.compounded(ret, trailing).alias("_r_growth"),
        F.stddev_samp(ret).over(trailing).alias("_r_std"),
        *stats.beta_parts(ret, market, "_b", betas),
        *stats.beta_parts(ret, F.when(market < 0, market), "_d", betas),
        *stats.skew_parts(firm, "_f", trailing),
        *stats.duvol_parts(firm, "_f", trailing),
    ]
    for n in settings.controversy_windows:
        parts += [
            (score - F.lag(score, n).over(by_ticker())).alias(f"controversy_change_{n}w"),
            F.avg(score).over(rolling(n)).alias(f"controversy_rolling_mean_{n}w"),
            F.stddev_samp(score).over(rolling(n)).alias(f"controversy_rolling_std_{n}w"),
        ]
    if with_targets:
        ahead = forward(settings.horizon)
        parts += [*stats.skew_parts(firm, "_a", ahead), *stats.duvol_parts(firm, "_a", ahead)]

    longest = max(settings.controversy_windows)
    spike = score > F.col(f"controversy_rolling_mean_{longest}w") + 2.0 * F.coalesce(
        F.col(f"controversy_rolling_std_{longest}w"), F.lit(0.0)
    ) + F.lit(settings.spike_margin)
    beta = stats.beta_from("_b", beta_min)
    # the downside beta also waits for enough pairs of the whole window
    downside = F.when(F.col("_b_pairs") >= beta_min, stats.beta_from("_d", 3))
    detrended = F.when(F.col("_t_n") >= trade_min, turnover - F.col("_t_mean"))
    made = {
        "detrended_turnover": detrended,
        "turnover_zscore": F.when(
            F.col("_t_n") >= trade_min, (turnover - F.col("_t_mean")) / F.nullif("_t_std", F.lit(0.0))
        ),
        "trailing_return": F.when(F.col("_r_n") >= trailing_min, F.col("_r_growth")),
        "realized_volatility": F.when(
            F.col("_r_n") >= trailing_min, F.col("_r_std") * F.sqrt(F.lit(52.0))
        ),
        "beta": beta,
        "downside_beta": downside,
        "relative_downside_beta": downside - beta,
        "controversy_spike_flag": F.coalesce(spike.cast("int"), F.lit(0)),
        "lagged_ncskew": stats.ncskew_from("_f", trailing_min),
        "lagged_duvol": stats.duvol_from("_f", max(4, trailing_min)),
        "sector": F.coalesce("sector", F.lit("Unknown")),
    }
    if with_targets:
        made["future_ncskew"] = stats.ncskew_from("_a")
        made["future_duvol"] = stats.duvol_from("_a")
    frames = ("_f", "_a") if with_targets else ("_f",)
    rolled = base.select("*", *parts)
    for step in (stats.duvol_split, stats.duvol_sides):
        rolled = rolled.withColumns({name: made_ for frame in frames for name, made_ in step(frame).items()})
    return rolled.withColumns(made).drop(*[c for c in rolled.columns if c.startswith("_")])


def feature_panel(
    tables: dict[str, DataFrame], settings: Settings | None = None, with_targets: bool = False
) -> DataFrame:
    """The full panel, one row per ticker and Friday.

    `with_targets` adds the forward metrics.
    """
    return _panel(_staged_base(tables, settings or Settings(), with_targets), settings or Settings())


def _staged_base(tables: dict[str, DataFrame], settings: Settings, with_targets: bool) -> DataFrame:
    """The narrow rows that the cross-sections rank and the windows roll over, written once."""
    base = base_panel(tables).withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    return stage(with_forward_metrics(base, settings.horizon) if with_targets else base, "panel")


def _panel(base: DataFrame, settings: Settings) -> DataFrame:
    """The rolling features on top of the sector rank.

    The rank is worked out on four columns and comes back as one more as-of side, whose exchange and sort by
    ticker serve the windows too: wide rows are made behind the last shuffle and never move.
    """
    name = "controversy_sector_percentile"
    ranked = with_sector_percentile(base.select("ticker", "date", "sector", "controversy_score"))
    known = asof_attach(base, [AsofSide(ranked, "date", (name,))], by="ticker", on="date")
    return with_rolling_features(known, settings)


def with_sector_percentile(rolled: DataFrame) -> DataFrame:
    return attach_percentile(
        rolled, ["date", "sector"], "controversy_score", "controversy_sector_percentile"
    )


def with_forward_metrics(
    panel: DataFrame, horizon: int = 13, residual: str = "firm_specific_return"
) -> DataFrame:
    """NCSKEW and DUVOL of the weeks t+1 to t+horizon; the current week is left out."""
    ahead = forward(horizon)
    parts = panel.select(
        "*",
        *stats.skew_parts(F.col(residual), "_a", ahead),
        *stats.duvol_parts(F.col(residual), "_a", ahead),
    ).withColumns(stats.duvol_split("_a")).withColumns(stats.duvol_sides("_a"))
    return parts.select(
        *panel.columns,
        stats.ncskew_from("_a").alias("future_ncskew"),
        stats.duvol_from("_a").alias("future_duvol"),
    )


def with_labels(
    panel: DataFrame,
    top_share: float = 0.20,
    measured_on: DataFrame | None = None,
    metric: str = "future_ncskew",
    margin: float = 0.0,
) -> DataFrame:
    """1 for the top share of each date's known forward metric, 0 below, null if unknown.

    `measured_on` is a staged table with the same rows to take the thresholds from. Rows that are equal but for float
    noise meet the threshold together if `margin` is above the noise.
    """
    if not 0 < top_share < 1:
        raise ValueError("top_share must be between 0 and 1")
    source = panel if measured_on is None else measured_on
    # one threshold per calendar week
    thresholds = F.broadcast(group_quantile(source, ["date"], metric, 1.0 - top_share, "_threshold"))
    labelled = panel.join(thresholds, "date", "left")
    return labelled.withColumn(
        "high_crash_risk", (F.col(metric) >= F.col("_threshold") - F.lit(margin)).cast("int")
    ).drop("_threshold")


def labelled_panel(tables: dict[str, DataFrame], settings: Settings | None = None) -> DataFrame:
    """Features, forward metrics and label."""
    settings = settings or Settings()
    base = _staged_base(tables, settings, with_targets=True)
    return with_labels(_panel(base, settings), settings.top_share, measured_on=base, margin=settings.label_margin)

"""Portfolios that leave out the riskiest names, and what they earned.

Per-date tables have one row per calendar week; ordered work on them (cumulative products,
drawdown, historical VaR) runs in one task by design.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.functions import stats
from tailspark.operators.calendar import date_at, dates_of, following_dates, quarter_label
from tailspark.operators.ranking import with_risk_bucket
from tailspark.operators.resample import change_from_previous
from tailspark.staging import stage


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def _with_weekly_return(panel: DataFrame) -> DataFrame:
    if "weekly_return" in panel.columns:
        return panel
    if "adj_close" not in panel.columns:
        raise ValueError("panel must contain weekly_return or adj_close")
    return panel.withColumn("weekly_return", change_from_previous("adj_close", _by_ticker()))


def _equal_weight(rows: DataFrame, value: str) -> DataFrame:
    """Per date: mean of all names and of the names outside High; all names if none is left."""
    held = F.col("risk_bucket") != "High"
    return rows.groupBy("date").agg(
        F.coalesce(F.avg(F.when(held, F.col(value))), F.avg(value)).alias("strategy"),
        F.avg(value).alias("benchmark"),
        F.count_if(held).alias("n_holdings"),
        F.count_if(~held).alias("n_excluded"),
    )


def forward_buckets(scored: DataFrame, start_share: float = 0.60, high_share: float = 0.20) -> DataFrame:
    """(date, ticker, crash_probability, next_week_return, risk_bucket) after the start date.

    `scored` is a stored panel with a probability on every row. Only names with a return
    in the following row take part.
    """
    panel = _with_weekly_return(scored)
    n_dates, start = date_at(scored, start_share)
    ahead = panel.select(
        "ticker",
        "date",
        "crash_probability",
        F.lead("weekly_return").over(_by_ticker()).alias("next_week_return"),
    )
    if n_dates < 3:
        return with_risk_bucket(ahead.where("false"), ["date"], high_share=high_share)
    usable = ahead.where((F.col("date") > F.lit(start)) & F.col("next_week_return").isNotNull())
    return with_risk_bucket(usable, ["date"], high_share=high_share)


def forward_overlay(
    scored: DataFrame,
    start_share: float = 0.60,
    high_share: float = 0.20,
    list_excluded: bool = False,
) -> DataFrame:
    """Weekly returns of holding everything but the High names of the week before.

    All weeks are bucketed and averaged in one pass. The names left out are long-form rows
    in `excluded_names`; `list_excluded` adds the joined list per week for reports on
    universes whose fifth fits one cell.
    """
    buckets = forward_buckets(scored, start_share, high_share)
    if list_excluded:
        buckets = stage(buckets, "buckets")
    weekly = _equal_weight(buckets, "next_week_return").join(
        F.broadcast(following_dates(scored)), "date", "left"
    )
    columns = ["date", "return_date", "strategy", "benchmark", "n_holdings", "n_excluded"]
    if list_excluded:
        names = (
            buckets.where("risk_bucket = 'High'")
            .groupBy("date")
            .agg(F.array_join(F.sort_array(F.collect_list("ticker")), ";").alias("excluded_tickers"))
        )
        weekly = weekly.join(names, "date", "left")
        columns.append("excluded_tickers")
    return weekly.select(*columns)


def excluded_names(scored: DataFrame, start_share: float = 0.60, high_share: float = 0.20) -> DataFrame:
    """One row per week and name left out."""
    return forward_buckets(scored, start_share, high_share).where("risk_bucket = 'High'").select(
        "date", "ticker", "crash_probability"
    )


def latest_score_overlay(price_history: DataFrame, scores: DataFrame, start_share: float = 0.60) -> DataFrame:
    """The older variant: today's buckets applied to every week after the start date."""
    returns = price_history.select(
        "ticker", "date", change_from_previous("adj_close", _by_ticker()).alias("weekly_return")
    )
    n_dates, start = date_at(price_history, start_share)
    keep = F.lit(False) if n_dates < 10 else F.col("date") > F.lit(start)
    bucketed = (
        returns.where(keep & F.col("weekly_return").isNotNull())
        .join(scores.select("ticker", "risk_bucket"), "ticker", "left")
        .withColumn("risk_bucket", F.coalesce("risk_bucket", F.lit("Low")))
    )
    return _equal_weight(bucketed, "weekly_return").select("date", "strategy", "benchmark")


def rounded(value: Column, digits: int) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.round(value, digits))


NOTE = (
    "Stylised simulation, illustrative only: trading costs, market impact, capacity limits, "
    "model uncertainty and implementation slippage are left out."
)


def _side_path(side: str) -> list[Column]:
    """Wealth to date and rank of the return, for one return column of the weekly table."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = F.coalesce(F.col(side), F.lit(0.0))
    return [
        r.alias(side),
        F.product(1.0 + r).over(upto).alias(f"{side}_wealth"),
        F.row_number().over(Window.orderBy(r, "date")).alias(f"{side}_place"),
    ]


def _side_metrics(side: str, weekly_rf: float) -> list[Column]:
    r, wealth, peak, place = (F.col(f"{side}{part}") for part in ("", "_wealth", "_peak", "_place"))
    # the confidence is turned into a row count in doubles, as 1 - 0.95 is not quite 0.05
    cutoff = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1.0 - 0.95)))
    tail = F.when(F.col("n") >= 10, r)
    drawdown = F.min((wealth - peak) / F.nullif(peak, F.lit(0.0)))
    return [
        stats.annualised_return(r).alias(f"{side}_annual"),
        stats.sharpe(r, weekly_rf).alias(f"{side}_sharpe"),
        stats.sortino(r, weekly_rf).alias(f"{side}_sortino"),
        F.when(F.count("*") >= 2, drawdown).alias(f"{side}_drawdown"),
        (-F.max(F.when(place == cutoff, tail))).alias(f"{side}_var"),
        (-F.avg(F.when(place <= cutoff, tail))).alias(f"{side}_cvar"),
    ]


def business_summary(
    perf: DataFrame,
    fund_aum: float = 1_000_000_000.0,
    annual_risk_free: float = 0.04,
    team_cost: float = 800_000.0,
    scores: DataFrame | None = None,
) -> DataFrame:
    """One wide row of performance and value figures; no row for fewer than 8 weeks."""
    weekly_rf = annual_risk_free / 52.0
    overlay = {"n_excluded", "n_holdings"} <= set(perf.columns)
    if overlay:
        universe = F.col("n_excluded") + F.col("n_holdings")
        share = F.col("n_excluded") / F.nullif(universe, F.lit(0))
    elif scores is not None:
        share = scores.agg(F.avg((F.col("risk_bucket") == "High").cast("double"))).scalar()
    else:
        share = F.lit(None).cast("double")
    method = "weekly_forward_overlay" if overlay else "latest_score_overlay"

    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = perf.select(
        "date",
        share.alias("excluded"),
        *_side_path("strategy"),
        *_side_path("benchmark"),
        F.count("*").over(Window.partitionBy()).alias("n"),
    ).withColumns({f"{side}_peak": F.max(f"{side}_wealth").over(upto) for side in ("strategy", "benchmark")})
    wide = path.agg(
        F.count("*").alias("weeks"),
        F.avg("excluded").alias("excluded"),
        *_side_metrics("strategy", weekly_rf),
        *_side_metrics("benchmark", weekly_rf),
    ).where("weeks >= 8")
    s = {c: F.col(c) for c in wide.columns}
    alpha = s["strategy_annual"] - s["benchmark_annual"]
    gain = fund_aum * alpha
    roi = gain / team_cost if team_cost > 0 else F.lit(None).cast("double")
    return wide.select(
        rounded(s["strategy_annual"], 4).alias("strategy_annual_return"),
        rounded(s["benchmark_annual"], 4).alias("benchmark_annual_return"),
        rounded(alpha, 4).alias("alpha_annualized"),
        F.lit(0.0).alias("benchmark_alpha_annualized"),
        rounded(s["strategy_sharpe"], 3).alias("strategy_sharpe"),
        rounded(s["benchmark_sharpe"], 3).alias("benchmark_sharpe"),
        rounded(s["strategy_sortino"], 3).alias("strategy_sortino"),
        rounded(s["benchmark_sortino"], 3).alias("benchmark_sortino"),
        rounded(s["strategy_drawdown"], 4).alias("max_drawdown_strategy"),
        rounded(s["benchmark_drawdown"], 4).alias("max_drawdown_benchmark"),
        rounded(s["benchmark_drawdown"] - s["strategy_drawdown"], 4).alias("drawdown_improvement"),
        rounded(s["strategy_var"], 4).alias("var_95_weekly"),
        rounded(s["benchmark_var"], 4).alias("benchmark_var_95_weekly"),
        rounded(s["strategy_cvar"], 4).alias("cvar_95_weekly"),
        rounded(s["benchmark_cvar"], 4).alias("benchmark_cvar_95_weekly"),
        s["weeks"].alias("evaluation_weeks"),
        rounded(s["excluded"], 3).alias("high_risk_excluded_pct"),
        F.lit(0.0).alias("benchmark_high_risk_excluded_pct"),
        F.lit(method).alias("business_analysis_method"),
        F.lit(float(fund_aum)).alias("fund_aum"),
        rounded(gain, 0).alias("economic_gain_annual"),
        F.lit(0.0).alias("benchmark_economic_gain_annual"),
        F.lit(float(team_cost)).alias("team_annual_cost"),
        rounded(roi, 2).alias("team_roi"),
        F.lit("-").alias("benchmark_team_roi"),
        F.coalesce(gain > team_cost, F.lit(False)).alias("justifies_team"),
        F.lit(NOTE).alias("business_analysis_note"),
    )


def quarter_dates(
    panel: DataFrame, cutoff: str | dt.date | None = None, forward_weeks: int = 13
) -> tuple[dt.date, list[dt.date]]:
    """The cutoff date in the panel and the dates that follow it, at most `forward_weeks`."""
    dates = dates_of(panel)
    if dates.count() < forward_weeks + 2:
        raise ValueError("not enough dates in panel for the quarter backtest")
    if cutoff is None:
        newest = [r.date for r in dates.orderBy(F.col("date").desc()).limit(forward_weeks + 1).collect()]
        return newest[-1], sorted(newest[:-1])
    at = dates.where(F.col("date") <= F.lit(cutoff).cast("date")).agg(F.max("date").alias("d")).first().d
    if at is None:
        raise ValueError(f"cutoff_date {cutoff} is before any data")
    ahead = dates.where(F.col("date") > F.lit(at)).orderBy("date").limit(forward_weeks).collect()
    if not ahead:
        raise ValueError("no forward dates available after cutoff")
    return at, [r.date for r in ahead]


def quarter_backtest(
    scored: DataFrame,
    cutoff: str | dt.date | None = None,
    forward_weeks: int = 13,
    high_share: float = 0.20,
    fund_aum: float = 1_000_000_000.0,
    features: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """Score once at the cutoff, then follow the portfolio for a quarter.

    Gives `weekly` (cumulative returns), `excluded` (each High name, its return and
    outcome) and `summary` (one row). `scored` is a stored panel.
    """
    panel = _with_weekly_return(scored)
    at, ahead = quarter_dates(scored, cutoff, forward_weeks)
    # a name needs at least one known feature to be scored
    known = F.coalesce(*[F.col(f).cast("string") for f in features]).isNotNull() if features else F.lit(True)
    universe = stage(
        with_risk_bucket(
            panel.where((F.col("date") == F.lit(at)) & known).select(
                "date", "ticker", "crash_probability"
            ),
            ["date"],
            high_share=high_share,
        ),
        "universe",
    )
    buckets = universe.select("ticker", "crash_probability", "risk_bucket")

    forward = panel.where(F.col("date").isin(ahead) & F.col("weekly_return").isNotNull())
    weekly_returns = _equal_weight(
        forward.select("date", "ticker", "weekly_return")
        .join(buckets, "ticker", "left")
        .withColumn("risk_bucket", F.coalesce("risk_bucket", F.lit("Low"))),
        "weekly_return",
    )
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = weekly_returns.select(
        "date",
        F.product(1.0 + F.col("strategy")).over(upto).alias("s"),
        F.product(1.0 + F.col("benchmark")).over(upto).alias("b"),
    )
    weekly = path.select(
        "date",
        F.round("s", 6).alias("strategy_cumulative"),
        F.round("b", 6).alias("benchmark_cumulative"),
    )

    if "adj_close" in panel.columns:
        ends = panel.where(F.col("date").isin([at, ahead[-1]])).groupBy("ticker").agg(
            F.max(F.when(F.col("date") == F.lit(at), F.col("adj_close"))).alias("p0"),
            F.max(F.when(F.col("date") == F.lit(ahead[-1]), F.col("adj_close"))).alias("p1"),
        )
        priced = ends.select(
            "ticker",
            F.when(F.col("p1") != 0, F.col("p1") / F.nullif("p0", F.lit(0.0)) - 1.0).alias("q"),
        )
        high = buckets.where("risk_bucket = 'High'").join(priced, "ticker", "left")
    else:
        high = buckets.where("risk_bucket = 'High'").withColumn("q", F.lit(None).cast("double"))
    excluded = high.select(
        "ticker",
        F.round("crash_probability", 4).alias("crash_probability"),
        F.round("q", 4).alias("quarter_return"),
        F.when(F.col("q") < 0, "Avoided loss")
        .when(F.col("q").isNotNull(), "Model missed")
        .otherwise("No price data")
        .alias("outcome"),
    )

    end = path.agg(
        F.count("*").alias("weeks"), F.max_by("s", "date").alias("s"), F.max_by("b", "date").alias("b")
    )
    n_high = F.count_if(F.col("risk_bucket") == "High")
    right = F.count_if(F.col("quarter_return") < 0) / F.nullif(F.count("quarter_return"), F.lit(0))
    gap = F.col("s") - F.col("b")
    summary = end.select(
        F.lit(at).alias("cutoff_date"),
        quarter_label(F.lit(ahead[-1])).alias("quarter_label"),
        F.col("weeks").alias("forward_weeks"),
        F.round(F.col("s") - 1.0, 4).alias("strategy_quarter_return"),
        F.round(F.col("b") - 1.0, 4).alias("benchmark_quarter_return"),
        F.round(gap * 10_000).cast("bigint").alias("outperformance_bps"),
        F.round(fund_aum * gap, 0).alias("dollar_impact_quarter"),
        F.round(fund_aum * gap * 4, 0).alias("dollar_impact_annualised"),
        universe.agg(n_high).scalar().alias("n_excluded"),
        universe.agg(F.count("*") - n_high).scalar().alias("n_held"),
        excluded.agg(F.round(right, 4)).scalar().alias("pct_excluded_correct"),
    )
    returns = weekly_returns.select(
        "date",
        F.round("strategy", 6).alias("strategy_weekly_return"),
        F.round("benchmark", 6).alias("benchmark_weekly_return"),
    )
    return {"weekly": weekly, "returns": returns, "excluded": excluded, "summary": summary}

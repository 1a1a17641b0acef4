"""Statistics as column expressions; each works as a group aggregate or over a frame.

`over` is a window frame or None. Null marks a missing value throughout; the loaders turn
NaN and infinities into null, so plain SQL null-skipping gives the pairwise rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def _on(aggregate: Column, over: WindowSpec | None) -> Column:
    return aggregate if over is None else aggregate.over(over)


def finite(value: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def gated(aggregate: Column, value: Column, over: WindowSpec, min_periods: int) -> Column:
    """The aggregate where its frame holds enough non-null values, else null."""
    return F.when(F.count(value).over(over) >= min_periods, aggregate.over(over))


# A statistic that needs several aggregates of one frame comes as `*_parts`, the aggregates
# under a column prefix, and `*_from`, the value made of them. Selecting the parts first
# computes every aggregate once, however often the formula names it.


def skew_parts(returns: Column, prefix: str, over: WindowSpec | None = None) -> list[Column]:
    return [
        _on(F.count(returns), over).alias(f"{prefix}_n"),
        _on(F.sum(returns * returns), over).alias(f"{prefix}_s2"),
        _on(F.sum(returns * returns * returns), over).alias(f"{prefix}_s3"),
    ]


def ncskew_from(prefix: str, min_periods: int = 3) -> Column:
    """Negative coefficient of skewness from three power sums (returns are not demeaned)."""
    n, squares, cubes = (F.col(f"{prefix}_{part}") for part in ("n", "s2", "s3"))
    skew = -(n * F.pow(n - 1, F.lit(1.5)) * cubes) / (
        (n - 1) * (n - 2) * F.pow(squares, F.lit(1.5))
    )
    return F.when((n >= max(3, min_periods)) & (squares > 0), skew)


def duvol_parts(returns: Column, prefix: str, over: WindowSpec | None = None) -> list[Column]:
    """The frame's values are held as an array, which the frame's length bounds."""
    return [
        _on(F.collect_list(returns), over).alias(f"{prefix}_values"),
        _on(F.avg(returns), over).alias(f"{prefix}_mean"),
    ]


def duvol_split(prefix: str) -> dict[str, Column]:
    """The values below the mean, which the array is walked once for. Those at or above it follow from the
    frame's count and squares (`skew_parts` of the same prefix)."""
    values, mean = F.col(f"{prefix}_values"), F.col(f"{prefix}_mean")
    return {f"{prefix}_below": F.filter(values, lambda value: value < mean)}


def duvol_sides(prefix: str) -> dict[str, Column]:
    """Count and squares on each side of the mean, after `duvol_split`."""
    below = F.col(f"{prefix}_below")
    down = F.aggregate(below, F.lit(0.0), lambda total, value: total + value * value)
    return {f"{prefix}_n_down": F.size(below), f"{prefix}_down": down}


def duvol_from(prefix: str, min_periods: int = 4) -> Column:
    """Down-to-up volatility, split at the mean of the same returns."""
    n, squares, n_down, down = (F.col(f"{prefix}_{part}") for part in ("n", "s2", "n_down", "down"))
    n_up, up = n - n_down, squares - down
    return F.when(
        (n_down + n_up >= max(4, min_periods)) & (n_down > 1) & (n_up > 1) & (down > 0) & (up > 0),
        F.ln(((n_up - 1) * down) / ((n_down - 1) * up)),
    )


def beta_parts(stock: Column, market: Column, prefix: str, over: WindowSpec | None = None) -> list[Column]:
    return [
        _on(F.count(F.when(market.isNotNull(), stock)), over).alias(f"{prefix}_pairs"),
        _on(F.covar_samp(stock, market), over).alias(f"{prefix}_cov"),
        _on(F.var_samp(F.when(stock.isNotNull(), market)), over).alias(f"{prefix}_var"),
    ]


def beta_from(prefix: str, min_pairs: int = 3) -> Column:
    """Covariance over variance of the complete pairs."""
    pairs, cov, var = (F.col(f"{prefix}_{part}") for part in ("pairs", "cov", "var"))
    return F.when((pairs >= max(3, min_pairs)) & (var > 0), cov / var)


def compounded(returns: Column, over: WindowSpec | None = None) -> Column:
    """Product of (1 + r), less one."""
    return _on(F.product(1.0 + returns), over) - 1.0


def annualised_return(returns: Column) -> Column:
    n = F.count(returns)
    growth = F.product(1.0 + returns)
    return F.when(n >= 2, F.pow(growth, F.lit(52.0) / n) - 1.0)


def sharpe(returns: Column, weekly_rf: float) -> Column:
    excess = returns - weekly_rf
    spread = F.stddev_samp(excess)
    return F.when((F.count(excess) >= 4) & (spread != 0), F.avg(excess) / spread * F.sqrt(F.lit(52.0)))


def sortino(returns: Column, weekly_rf: float) -> Column:
    excess = returns - weekly_rf
    losses = F.when(excess < 0, excess)
    spread = F.stddev_samp(losses)
    return F.when((F.count(losses) >= 2) & (spread != 0), F.avg(excess) / spread * F.sqrt(F.lit(52.0)))

"""Run settings. Every default is a fixed value of the published method."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the method: the model features in their published order.
FEATURES = (
    "lagged_ncskew",
    "lagged_duvol",
    "detrended_turnover",
    "trailing_return",
    "realized_volatility",
    "beta",
    "downside_beta",
    "relative_downside_beta",
    "market_cap",
    "market_to_book",
    "leverage",
    "roa",
    "controversy_score",
    "controversy_change_4w",
    "controversy_change_13w",
    "controversy_change_26w",
    "controversy_rolling_mean_13w",
    "controversy_rolling_std_13w",
    "controversy_spike_flag",
    "controversy_sector_percentile",
)

# Text signals join the panel but are not model features unless asked for.
TEXT_SIGNALS = ("negative_esg_controversy_score_0_100", "rolling_sentiment_13w")

# Fixed values of the method: the group each feature is reported under.
FEATURE_GROUPS = {
    "lagged_ncskew": "Crash history",
    "lagged_duvol": "Crash history",
    "detrended_turnover": "Trading activity",
    "trailing_return": "Downside risk",
    "realized_volatility": "Downside risk",
    "beta": "Downside risk",
    "downside_beta": "Downside risk",
    "relative_downside_beta": "Downside risk",
    "market_cap": "Fundamentals",
    "market_to_book": "Fundamentals",
    "leverage": "Fundamentals",
    "roa": "Fundamentals",
    "controversy_score": "ESG controversy",
    "controversy_change_4w": "ESG controversy",
    "controversy_change_13w": "ESG controversy",
    "controversy_change_26w": "ESG controversy",
    "controversy_rolling_mean_13w": "ESG controversy",
    "controversy_rolling_std_13w": "ESG controversy",
    "controversy_spike_flag": "ESG controversy",
    "controversy_sector_percentile": "ESG controversy",
    "negative_esg_controversy_score_0_100": "Text signal",
    "rolling_sentiment_13w": "Text signal",
}


@dataclass(frozen=True)
class Settings:
    fundamentals_lag_days: int = 45
    trailing_window: int = 26
    turnover_window: int = 26
    beta_window: int = 26
    min_observations: int = 8
    horizon: int = 13
    top_share: float = 0.20
    controversy_windows: tuple[int, ...] = (4, 13, 26)
    spike_margin: float = 0.0  # a score equal to its mean is a spike or not by float noise unless this is above the noise
    label_margin: float = 0.0  # copies of the row at the threshold are labelled alike only if this is above the float noise
    train_fraction: float = 0.60
    validation_fraction: float = 0.20
    seed: int = 42
    features: tuple[str, ...] = FEATURES
    model_type: str = "logistic_regression"
    cv_folds: int = 5

    def min_periods(self, window: int) -> int:
        """Observations a rolling window must hold before it gives a value."""
        return max(3, min(self.min_observations, window))

    def esg_features(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if is_esg(f))

    def baseline_features(self) -> tuple[str, ...]:
        return tuple(f for f in self.features if not is_esg(f))


def is_esg(column: str) -> bool:
    return column.startswith("controversy_")


def feature_group(column: str) -> str:
    return FEATURE_GROUPS.get(column, "Other")


class SchemaError(ValueError):
    """An input table lacks a required column or has no rows."""


def require_columns(columns, required, context: str) -> None:
    missing = [c for c in required if c not in columns]
    if missing:
        raise SchemaError(f"{context} is missing required column(s): {', '.join(missing)}")

"""What the raw tables held and what the loaders removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailspark.config import Settings
from tailspark.sources.loaders import DATE_COLUMN, NUMERIC, REQUIRED, number, parsed_date

CHECK_SCHEMA = "dataset string, check string, value string, denominator bigint, percent double, detail string"


def _blank(column: str) -> Column:
    cell = F.col(column)
    return cell.isNull() | (F.trim(cell.cast("string")) == "")


def _at_least_one(value: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), value.cast("long"))


def _surplus(raw: DataFrame, columns: list[str]) -> Column:
    """Rows beyond the first of each distinct combination (null equals null).

    Counted on a 128-bit digest of the cells, so two numbers a row are shuffled whatever its width; two
    different rows of a table of 10^12 share a digest with probability 10^-15.
    """
    # a missing cell and one that holds the mark of a missing cell differ, as do cells cut at other places
    cells = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    halves = [F.xxhash64(F.lit(seed), *cells) for seed in (1, 2)]
    groups = raw.groupBy(halves[0].alias("a"), halves[1].alias("b")).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).scalar()


def dataset_checks(name: str, raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """All checks of one table: one aggregation of the raw strings, and one grouping each
    for full and for entity-date duplicates."""
    required = [c for c in REQUIRED[name] if c in raw.columns]
    date = DATE_COLUMN[name]
    rows = F.count("*")
    checks: list[tuple[str, Column, Column, str]] = [
        (
            "missing_required_values",
            sum((F.count_if(_blank(c)) for c in required), F.lit(0)),
            rows * len(REQUIRED[name]),
            "Blank cells in required columns before loading.",
        ),
        (
            "missing_required_rows",
            F.count_if(F.exists(F.array(*[_blank(c) for c in required]), lambda b: b)),
            rows,
            "Rows with at least one blank required cell before loading.",
        ),
        ("duplicate_rows", _surplus(raw, raw.columns), rows, "Fully repeated raw rows."),
        (
            "rows_removed_or_invalid",
            F.greatest(F.lit(0).cast("long"), rows - loaded.agg(F.count("*")).scalar()),
            rows,
            "Rows the loader did not keep.",
        ),
    ]
    if date in raw.columns:
        checks.append(
            (
                f"invalid_{date}_values",
                F.count_if(parsed_date(raw, date).isNull()),
                rows,
                f"Rows whose {date} is not a date.",
            )
        )
        entity = [c for c in ("ticker", date) if c in raw.columns]
        checks.append(
            (
                "duplicate_entity_date_rows",
                _surplus(raw, entity),
                rows,
                f"Repeated rows by {', '.join(entity)}.",
            )
        )
    for column in (c for c in NUMERIC[name] if c in raw.columns):
        filled = ~_blank(column)
        checks.append(
            (
                f"{column}_numeric_coercion_failures",
                F.count_if(filled & number(column).isNull()),
                F.count_if(filled),
                f"Filled {column} cells that are not numbers.",
            )
        )
    for check, condition, detail in _domain_checks(name, raw.columns):
        checks.append((check, F.count_if(condition), rows, detail))

    counted = raw.agg(
        *[value.cast("long").alias(f"v{i}") for i, (_, value, _, _) in enumerate(checks)],
        *[_at_least_one(base).alias(f"d{i}") for i, (_, _, base, _) in enumerate(checks)],
    )
    lines = [
        F.struct(
            F.lit(name).alias("dataset"),
            F.lit(check).alias("check"),
            F.col(f"v{i}").cast("string").alias("value"),
            F.col(f"d{i}").alias("denominator"),
            F.round(F.col(f"v{i}") / F.col(f"d{i}") * 100.0, 4).alias("percent"),
            F.lit(detail).alias("detail"),
        )
        for i, (check, _, _, detail) in enumerate(checks)
    ]
    return counted.select(F.inline(F.array(*lines)))


def _domain_checks(name: str, columns: list[str]) -> list[tuple[str, Column, str]]:
    checks = []
    positive = {
        "prices": ("adj_close", "volume"),
        "benchmark_prices": ("benchmark_close",),
        "fundamentals": ("market_cap", "shares_outstanding"),
    }
    if name == "fundamentals":
        checks += [
            (f"retained_missing_{c}", number(c).isNull(), f"Missing {c} kept for median imputation.")
            for c in NUMERIC[name]
            if c in columns
        ]
    checks += [
        (f"zero_or_negative_{c}", number(c) <= 0, f"Rows with {c} at or below zero.")
        for c in positive.get(name, ())
        if c in columns
    ]
    if name == "controversies" and "controversy_score" in columns:
        checks.append(
            ("negative_controversy_score", number("controversy_score") < 0, "Rows with a score below zero.")
        )
    return checks


def cleaning_log(
    raw: dict[str, DataFrame], loaded: dict[str, DataFrame], settings: Settings | None = None
) -> DataFrame:
    settings = settings or Settings()
    log = None
    for name in REQUIRED:
        part = dataset_checks(name, raw[name], loaded[name])
        log = part if log is None else log.unionByName(part)
    spark = raw["prices"].sparkSession
    notes = [
        ("fundamentals", "availability_lag_days", str(settings.fundamentals_lag_days), "Days after period_end until use."),
        ("feature_engineering", "date_alignment_method", "weekly Friday observations", "Daily rows are cut to Fridays."),
        ("target_creation", "future_window", f"t+1 through t+{settings.horizon}", "Labels use later weeks only."),
    ]
    fixed = spark.createDataFrame([(d, c, v, None, None, t) for d, c, v, t in notes], CHECK_SCHEMA)
    return log.unionByName(fixed)


def _metric_lines(df: DataFrame, section: str, metrics: dict[str, tuple[Column, str]]) -> DataFrame:
    one = df.agg(*[value.cast("string").alias(m) for m, (value, _) in metrics.items()])
    return one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(section).alias("section"),
                        F.lit(m).alias("metric"),
                        F.coalesce(m, F.lit("")).alias("value"),
                        F.lit(detail).alias("detail"),
                    )
                    for m, (_, detail) in metrics.items()
                ]
            )
        )
    )


def data_summary(
    raw: dict[str, DataFrame],
    loaded: dict[str, DataFrame],
    panel: DataFrame,
    dataset: DataFrame,
    scores: DataFrame,
    files: dict[str, str] | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """(section, metric, value, detail) about every table of a run."""
    settings = settings or Settings()
    spark = panel.sparkSession
    parts = []
    for name in REQUIRED:
        table, date = loaded[name], DATE_COLUMN[name]
        if files and name in files:
            leaf = files[name].rstrip("/").rsplit("/", 1)[-1]
            parts.append(
                spark.createDataFrame(
                    [(name, "source_file", leaf, "Input of this run.")],
                    "section string, metric string, value string, detail string",
                )
            )
        metrics = {
            "raw_rows": (raw[name].agg(F.count("*")).scalar(), "Rows before cleaning."),
            "loaded_rows": (F.count("*"), "Rows after parsing and required-field filtering."),
        }
        if "ticker" in table.columns:
            metrics["ticker_count"] = (F.count_distinct("ticker"), "Distinct tickers after loading.")
        if "sector" in table.columns:
            metrics["sector_count"] = (F.count_distinct("sector"), "Distinct sectors after loading.")
        metrics["date_start"] = (F.min(date), "Earliest loaded date.")
        metrics["date_end"] = (F.max(date), "Latest loaded date.")
        parts.append(_metric_lines(table, name, metrics))
    parts.append(
        _metric_lines(
            panel,
            "feature_panel",
            {
                "rows": (F.count("*"), "Weekly ticker rows."),
                "ticker_count": (F.count_distinct("ticker"), "Distinct tickers in the panel."),
            },
        )
    )
    parts.append(_metric_lines(dataset, "model_dataset", {"rows": (F.count("*"), "Rows with forward labels.")}))
    parts.append(_metric_lines(scores, "stock_scores", {"rows": (F.count("*"), "Scored names.")}))
    parts.append(
        spark.createDataFrame(
            [
                ("configuration", "fundamentals_lag_days", str(settings.fundamentals_lag_days), "Availability lag."),
                ("configuration", "target_horizon_weeks", str(settings.horizon), "Forward label window."),
            ],
            "section string, metric string, value string, detail string",
        )
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

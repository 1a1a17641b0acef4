"""Every registered query with the SQL that checks it.

Queries on the panel share one staged copy per session and folder, as the stages of one
run do; `forget()` drops it, so a benchmark can time a query with all its work.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailspark.config import FEATURES, Settings, feature_group
from tailspark.operators import calendar, ranking, resample
from tailspark.operators.asof import asof_join
from tailspark.oracle import PANEL_DOUBLES, doubles, friday, sql
from tailspark.plans import (
    downside,
    evaluation,
    features,
    modelling,
    portfolio,
    quality,
    reports,
    text,
    variants,
)
from tailspark.sources import adapters, loaders, sinks
from tailspark.staging import stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Words that do occur in the test texts, in place of the default word lists.
LEXICON = {
    "negative": ("er", "nd", "ha"),
    "positive": ("th", "re", "he"),
    "controversy": ("es", "en", "ing"),
}


def register(name: str, oracle: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return add


def rounded(df: DataFrame, places: dict[str, int] | None = None) -> DataFrame:
    """Doubles to fixed places, 6 unless given.

    The midpoint is moved off one half: exact halves are common here (prices are cents over
    small counts) and float noise would send them either way in two engines.
    """
    places = places or {}
    return df.select(
        *[
            (F.floor(F.col(f.name) * 10.0 ** places.get(f.name, 6) + 0.5137) / 10.0 ** places.get(f.name, 6)).alias(
                f.name
            )
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def rounded_to_digits(df: DataFrame, columns: tuple[str, ...], digits: int = 10) -> DataFrame:
    """These columns to 6 places, or to `digits` significant digits where six places are more than a double carries."""

    def cut(x: Column) -> Column:
        places = F.least(F.lit(6.0), digits - 1 - F.floor(F.log10(F.abs(x))))
        up, down = F.pow(F.lit(10.0), F.greatest(places, F.lit(0.0))), F.pow(F.lit(10.0), F.greatest(-places, F.lit(0.0)))
        return F.when(x == 0, x).otherwise(F.floor(x * up / down + 0.5137) / up * down)

    return df.withColumns({c: cut(F.col(c)) for c in columns})


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def forget() -> None:
    _STAGED.clear()


def _known(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """What this session holds under the name, unless its files are gone."""
    found = _STAGED.get((spark.sparkContext.applicationId, folder, name))
    return found if found is not None and all(loaders._exists(spark, f) for f in found.inputFiles()[:1]) else None


def _once(function: Query, made: Callable[[DataFrame, str], DataFrame]) -> Query:
    name = function.__name__

    @wraps(function)
    def cached(spark: SparkSession, folder: str) -> DataFrame:
        if _known(spark, folder, name) is None:
            _STAGED[spark.sparkContext.applicationId, folder, name] = made(function(spark, folder), name)
        return _STAGED[spark.sparkContext.applicationId, folder, name]

    return cached


def shared(function: Query) -> Query:
    """Stage the result once per session and folder."""
    return _once(function, stage)


def planned(function: Query) -> Query:
    """Plan the result once per session and folder; what it stages on the way is written once, the result is not."""
    return _once(function, lambda df, name: df)


# --- shared inputs -----------------------------------------------------------------


# Sums of one ticker and its copies differ by float noise; a copy of the row at the threshold is labelled as that row.
LABEL_MARGIN = 1e-9


@planned
def labelled(spark: SparkSession, folder: str) -> DataFrame:
    return features.labelled_panel(adapters.model_tables(spark, folder), Settings(label_margin=LABEL_MARGIN))


@shared
def dataset(spark: SparkSession, folder: str) -> DataFrame:
    return labelled(spark, folder)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel for one pass over a few of its columns: the other windows are not worked out and nothing wide is written.

    A session that has the whole panel stored reads it.
    """
    stored = _known(spark, folder, "dataset")
    return labelled(spark, folder) if stored is None else stored


def fixed_probability(*terms: Column) -> Column:
    total = sum(terms[1:], terms[0])
    return F.round(1.0 / (1.0 + F.exp(-total)), 9)


def with_fixed_scores(rows: DataFrame) -> DataFrame:
    """A fixed logistic score, which SQL can repeat."""
    skew = 0.5 * F.coalesce("lagged_ncskew", F.lit(0.0))
    score = 0.1 * F.coalesce("controversy_score", F.lit(0.0))
    return rows.withColumns(
        {"crash_probability": fixed_probability(skew, score), "base_probability": fixed_probability(skew)}
    )


def scored_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The whole panel with its score."""
    return with_fixed_scores(dataset(spark, folder))


@shared
def panel_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every panel row, with its key, sector and label."""
    return with_fixed_scores(panel(spark, folder)).select(
        "ticker", "date", "sector", "high_crash_risk", "crash_probability", "base_probability"
    )


@planned
def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows with split and score."""
    rows = panel_scores(spark, folder).where(F.col("high_crash_risk").isNotNull())
    return calendar.chronological_split(rows).select(
        "ticker", "date", "high_crash_risk", "crash_probability", "base_probability", "split"
    )


@shared
def latest_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = panel_scores(spark, folder)
    newest = rows.where(F.col("date") == rows.agg(F.max("date")).scalar()).select(
        "ticker", "date", "crash_probability"
    )
    return ranking.with_risk_bucket(newest, ["date"]).select(
        "ticker", F.col("date").cast("string").alias("as_of_date"), "crash_probability", "risk_bucket"
    )


def news(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.news_text(spark, folder)


@shared
def weekly_news(spark: SparkSession, folder: str) -> DataFrame:
    return text.weekly_text(news(spark, folder), "documents", **LEXICON)


def two_models(spark: SparkSession, folder: str) -> DataFrame:
    """The two fixed scores as rows of two models, on validation and test."""
    rows = scored(spark, folder).where(F.col("split") != "train")
    return rows.select(
        "ticker",
        "date",
        "high_crash_risk",
        "split",
        F.inline(
            F.array(
                F.struct(F.lit("base").alias("model"), F.col("base_probability").alias("crash_probability")),
                F.struct(F.lit("full").alias("model"), F.col("crash_probability").alias("crash_probability")),
            )
        ),
    )


# --- raw text tables ---------------------------------------------------------------


def raw_prices(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.prices(spark, folder)
    day = F.dayofmonth("date")
    return rows.select(
        F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("Ticker"),
        F.date_format("date", "dd-MM-yyyy").alias(" Date"),
        F.when((day == 15) & F.col("ticker").endswith("3"), "bad")
        .otherwise(F.col("adj_close").cast("string"))
        .alias("adj_close"),
        F.when(day == 20, "n/a").otherwise(F.col("volume").cast("string")).alias("volume"),
    )


def raw_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.benchmark_prices(spark, folder).select(
        F.date_format("date", "MM/dd/yyyy").alias("date"),
        F.when(F.dayofmonth("date") == 15, "").otherwise(F.col("benchmark_close").cast("string")).alias("benchmark_close"),
    )


def raw_fundamentals(spark: SparkSession, folder: str) -> DataFrame:
    rows = adapters.fundamentals_raw(spark, folder)
    return rows.select(
        F.lower("ticker").alias("ticker"),
        F.col("period_end").cast("string").alias("period_end"),
        F.when(F.month("period_end") == 6, "x").otherwise(F.col("market_cap").cast("string")).alias("market_cap"),
        *[F.col(c).cast("string").alias(c) for c in ("shares_outstanding", "market_to_book", "leverage", "roa")],
    )


def raw_controversies(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.controversies(spark, folder).select(
        "ticker",
        F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("date"),
        F.concat(F.lit(" "), F.col("sector")).alias("sector"),
        F.when(F.month("date") == 1, "NaN").otherwise(F.col("controversy_score").cast("string")).alias("controversy_score"),
    )


LOADED_SQL = {
    "prices": """select ticker, date, adj_close, case when day(date) = 20 then null else volume end as volume
        from prices where not (day(date) = 15 and ticker like '%3')""",
    "benchmark_prices": "select date, benchmark_close from benchmark_prices where day(date) <> 15",
    "fundamentals": """select ticker, period_end, case when month(period_end) = 6 then null else market_cap end as market_cap,
        shares_outstanding, market_to_book, leverage, roa, available_date from fundamentals""",
    "controversies": """select ticker, date, sector, case when month(date) = 1 then null else controversy_score end as controversy_score
        from controversies""",
}


@register("load_prices", sql(LOADED_SQL["prices"], "prices", rounded="adj_close volume"))
def load_prices(spark, folder):
    """Day-first dates by vote, bad cells to null, padded lower-case tickers."""
    return rounded(loaders.load_prices(spark, raw_prices(spark, folder)))


@register("load_benchmark", sql(LOADED_SQL["benchmark_prices"], "benchmark_prices", rounded="benchmark_close"))
def load_benchmark(spark, folder):
    return rounded(loaders.load_benchmark(spark, raw_benchmark(spark, folder)))


@register(
    "load_fundamentals",
    sql(
        LOADED_SQL["fundamentals"],
        "fundamentals",
        rounded=doubles("market_cap", "shares_outstanding", "market_to_book", "leverage", "roa"),
    ),
)
def load_fundamentals(spark, folder):
    return rounded(loaders.load_fundamentals(spark, raw_fundamentals(spark, folder)), PANEL_DOUBLES)


@register("load_controversies", sql(LOADED_SQL["controversies"], "controversies", rounded="controversy_score"))
def load_controversies(spark, folder):
    return rounded(loaders.load_controversies(spark, raw_controversies(spark, folder)))


@register(
    "load_text",
    sql(
        "select ticker, date, concat(upper(source), ' ', text) as text, source from news_text",
        "news_text",
    ),
)
def load_text(spark, folder):
    """Alias column names, two text columns joined, month-first dates."""
    raw = news(spark, folder).select(
        F.col("ticker").alias("Symbol"),
        F.date_format("date", "MM/dd/yyyy").alias("Published Date"),
        F.col("source").alias("Provider"),
        F.upper("source").alias("Headline_Text"),
        F.col("text").alias("Story"),
    )
    return loaders.load_text(spark, raw).texts.select("ticker", "date", "text", "source")


@register(
    "csv_round_trip",
    sql(LOADED_SQL["prices"], "prices", rounded="adj_close volume"),
)
def csv_round_trip(spark, folder):
    """Write the raw prices as a CSV folder, read and clean them again."""
    path = staging_path(spark, "prices") + ".csv"
    sinks.write_csv(raw_prices(spark, folder), path)
    return rounded(loaders.load_prices(spark, path))


_MISSING = ", ".join(f"'{m}'" for m in loaders.MISSING)


@register(
    "multiline_csv",
    f"select doc_id, case when source not in ({_MISSING}) then source end as source, "
    f"case when text not in ({_MISSING}) then text end as text from documents",
)
def multiline_csv(spark, folder):
    """Write the texts as CSV with quoted line breaks; each file is read again by many tasks."""
    path = staging_path(spark, "texts") + ".csv"
    texts = adapters.table(spark, folder, "documents").select("doc_id", "source", "text")
    sinks.write_csv(texts, path)
    return loaders.read_table(spark, path, multiline=True).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register(
    "parquet_by_year",
    sql(
        "select *, year(date)::int as year from weekly where year(date) >= 1997",
        "weekly",
        rounded="adj_close weekly_volume weekly_return",
    ),
)
def parquet_by_year(spark, folder):
    """Year folders, then a scan that prunes to the years asked for."""
    path = staging_path(spark, "weekly") + ".parquet"
    sinks.write_parquet_by_year(resample.weekly_returns(adapters.prices(spark, folder)), path)
    return rounded(loaders.read_table(spark, path).where(F.col("year") >= 1997))


@register(
    "json_records",
    sql("select * from weekly", "weekly", rounded="adj_close weekly_volume weekly_return"),
)
def json_records(spark, folder):
    """Infinities leave as null, and null keys are written out."""
    weekly = resample.weekly_returns(adapters.prices(spark, folder)).withColumn(
        "weekly_return", F.coalesce("weekly_return", F.lit(float("inf")))
    )
    path = staging_path(spark, "json")
    sinks.write_payload({"weekly": weekly}, path)
    return rounded(spark.read.schema(weekly.schema).json(f"{path}/weekly"))


@register(
    "ticker_universe",
    "select concat('S', cast(s_suppkey as varchar)) as ticker, s_name as bloomberg_ticker, "
    "case when s_suppkey % 4 = 0 then concat('S', cast(s_suppkey as varchar)) else concat('Y', cast(s_suppkey as varchar)) end as yahoo_ticker from supplier",
)
def ticker_universe(spark, folder):
    suppliers = adapters.table(spark, folder, "supplier")
    raw = suppliers.select(
        F.col("s_name").alias("Bloomberg_Ticker"),
        F.concat(F.lit("s"), "s_suppkey").alias("ticker"),
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("Y"), "s_suppkey", F.lit(" "))).alias("yahoo_ticker"),
    )
    return loaders.load_ticker_universe(spark, raw)


@register("sector_map", sql("select ticker, min(sector) as sector from controversies group by ticker", "controversies"))
def sector_map(spark, folder):
    raw = adapters.controversies(spark, folder).select(F.lower("ticker").alias("ticker"), "sector")
    return loaders.load_sector_map(spark, raw)


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@register(
    "symbol_history",
    sql(
        """select r.r_name as ticker, p.date, sum(p.adj_close * p.volume) / sum(p.volume) as adj_close, sum(p.volume) as volume
        from prices p join supplier s on p.ticker = concat('S', cast(s.s_suppkey as varchar))
        join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
        group by 1, 2""",
        "prices",
        rounded="adj_close volume",
    ),
)
def symbol_history(spark, folder):
    """A wide table with a price and volume column per symbol, back to rows."""
    sectors = adapters.controversies(spark, folder).select("ticker", "sector").distinct()
    daily = adapters.prices(spark, folder).join(sectors, "ticker")
    wide = daily.groupBy("date").agg(
        *[
            aggregate
            for region in _REGIONS
            for inside in [F.col("sector") == region]
            for aggregate in (
                (
                    F.sum(F.when(inside, F.col("adj_close") * F.col("volume")))
                    / F.sum(F.when(inside, F.col("volume")))
                ).alias(f"{region}_Adj Close" if region != "ASIA" else f"{region}_Close"),
                F.sum(F.when(inside, F.col("volume"))).alias(f"{region}_Volume"),
            )
        ]
    )
    return rounded(loaders.symbol_history_to_long(wide, list(_REGIONS)))


@register(
    "plain_ratio",
    "select s_suppkey, floor(case when abs(s_acctbal / 500) > 10 then s_acctbal / 500 / 100 else s_acctbal / 500 end * 1e6 + 0.5137) / 1e6 as ratio from supplier",
)
def plain_ratio(spark, folder):
    return rounded(
        adapters.table(spark, folder, "supplier").select(
            "s_suppkey", loaders.plain_ratio((F.col("s_acctbal") / 500).cast("string")).alias("ratio")
        )
    )


# --- resampling and as-of joins ----------------------------------------------------


@register(
    "weekly_returns",
    sql("select ticker, date, adj_close, weekly_volume, weekly_return from weekly", "weekly", rounded="adj_close weekly_volume weekly_return"),
)
def weekly_returns(spark, folder):
    return rounded(resample.weekly_returns(adapters.prices(spark, folder)))


@register(
    "weekly_benchmark",
    sql("select * from bench_weekly", "bench_weekly", rounded="benchmark_close benchmark_return"),
)
def weekly_benchmark(spark, folder):
    return rounded(resample.weekly_benchmark(adapters.benchmark_prices(spark, folder)))


MONTHLY_SQL = """select g.ticker, g.date, m.adj_close from
    (select ticker, unnest(list_transform(generate_series(lo, hi, interval 1 month), lambda d: last_day(cast(d as date)))) as date
     from (select ticker, date_trunc('month', min(date)) as lo, date_trunc('month', max(date)) as hi from prices group by ticker) as span) g
    left join (select ticker, last_day(date) as date, arg_max(adj_close, date) as adj_close from prices group by 1, 2) m
    on g.ticker = m.ticker and g.date = m.date"""


@register("monthly_prices", sql(MONTHLY_SQL, "prices", rounded="adj_close"))
def monthly_prices(spark, folder):
    return rounded(resample.monthly_prices(adapters.prices(spark, folder)))


@register(
    "asof_fundamentals",
    sql(
        """select w.ticker, w.date, f.period_end, f.available_date, f.market_cap, f.shares_outstanding, f.market_to_book, f.leverage, f.roa
        from weekly w asof left join fundamentals f on w.ticker = f.ticker and f.available_date <= w.date""",
        "weekly",
        "fundamentals",
        rounded=doubles("market_cap", "shares_outstanding", "market_to_book", "leverage", "roa"),
    ),
)
def asof_fundamentals(spark, folder):
    weeks = resample.weekly_prices(adapters.prices(spark, folder)).select("ticker", "date")
    known = asof_join(
        weeks,
        adapters.fundamentals(spark, folder),
        "ticker",
        "date",
        "available_date",
        features.FUNDAMENTAL_COLUMNS,
        snap=resample.week_end,
    )
    return rounded(known, PANEL_DOUBLES)


@register(
    "asof_one_hot_key",
    """with days as (select cast(l_shipdate as date) as date, max(l_extendedprice) as top, count(*) as items from lineitem group by 1),
    sold as (select o_orderkey, case when o_orderpriority = '1-URGENT' then 'urgent' else 'rest' end as kind, cast(o_orderdate as date) as date from orders),
    known as (select kind, date, top, items from days, (select unnest(['rest', 'urgent']) as kind) where kind = 'rest' or items % 2 = 0)
    select s.o_orderkey, s.kind, s.date, k.top, k.items from sold s asof left join known k on s.kind = k.kind and k.date <= s.date""",
)
def asof_one_hot_key(spark, folder):
    """Every order with the newest day of shipments known by its date; four in five orders share one key."""
    days = adapters.table(spark, folder, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("known")).agg(
        F.max("l_extendedprice").alias("top"), F.count("*").alias("items")
    )
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("rest")
    sold = adapters.table(spark, folder, "orders").select("o_orderkey", kind.alias("kind"), F.col("o_orderdate").cast("date").alias("date"))
    known = days.withColumn("kind", F.explode(F.array(F.lit("rest"), F.lit("urgent")))).where("kind = 'rest' or items % 2 = 0")
    return asof_join(sold, known, "kind", "date", "known", ["top", "items"], any_size=True)


@register(
    "asof_controversies",
    sql(
        """select p.ticker, p.date, c.sector, c.controversy_score
        from prices p asof left join controversies c on p.ticker = c.ticker and c.date <= p.date""",
        "prices",
        "controversies",
        rounded="controversy_score",
    ),
)
def asof_controversies(spark, folder):
    """On daily rows, without a grid to snap to."""
    days = adapters.prices(spark, folder).select("ticker", "date")
    known = asof_join(days, adapters.controversies(spark, folder), "ticker", "date", "date", ("sector", "controversy_score"))
    return rounded(known)


@register(
    "firm_specific_returns",
    sql(
        "select ticker, date, weekly_return, benchmark_return, firm_specific_return from known",
        "known",
        rounded="weekly_return benchmark_return firm_specific_return",
    ),
)
def firm_specific_returns(spark, folder):
    panel = features.base_panel(adapters.model_tables(spark, folder))
    return rounded(panel.select("ticker", "date", "weekly_return", "benchmark_return", "firm_specific_return"))


# --- features and labels -----------------------------------------------------------

PANEL_COLUMNS = (
    "ticker", "date", "adj_close", "weekly_volume", "weekly_return", "benchmark_return",
    "firm_specific_return", "period_end", "available_date", "market_cap", "shares_outstanding",
    "market_to_book", "leverage", "roa", "turnover", "detrended_turnover", "turnover_zscore",
    "trailing_return", "realized_volatility", "beta", "downside_beta", "relative_downside_beta",
    "sector", "controversy_score", "controversy_change_4w", "controversy_rolling_mean_4w",
    "controversy_rolling_std_4w", "controversy_change_13w", "controversy_rolling_mean_13w",
    "controversy_rolling_std_13w", "controversy_change_26w", "controversy_rolling_mean_26w",
    "controversy_rolling_std_26w", "controversy_spike_flag", "controversy_sector_percentile",
    "lagged_ncskew", "lagged_duvol",
)


# A score that equals its mean is no spike: sums of equal scores miss it by float noise, one way or the other.
SPIKE_MARGIN = 1e-9


def settled(statement: str) -> str:
    """The same statement with nothing left to the order of sums: spikes above the noise, prices summed in whole cents."""
    spike = "2 * coalesce(controversy_rolling_std_26w, 0)"
    price = "sum(l_extendedprice) / sum(l_quantity)"
    return statement.replace(spike, f"{spike} + {SPIKE_MARGIN}").replace(price, "sum(round(l_extendedprice * 100)) / 100 / sum(l_quantity)")


@register(
    "feature_panel",
    settled(sql(f"select {', '.join(PANEL_COLUMNS)} from dataset", "dataset", rounded=PANEL_DOUBLES | {"weekly_volume": 6, "shares_outstanding": 6})),
)
def feature_panel(spark, folder):
    panel = features.feature_panel(adapters.model_tables(spark, folder), Settings(spike_margin=SPIKE_MARGIN))
    return rounded(panel.select(*PANEL_COLUMNS), PANEL_DOUBLES)


def _feature_query(name: str, *columns: str) -> None:
    used = [c for c in columns if c in PANEL_DOUBLES]
    statement = sql(f"select ticker, date, {', '.join(columns)} from dataset0", "dataset0", rounded=doubles(*used))
    spikes = "controversy_spike_flag" in columns

    @register(name, settled(statement) if spikes else statement)
    def query(spark, folder):
        base = features.base_panel(adapters.model_tables(spark, folder))
        rolled = features.with_rolling_features(base, Settings(spike_margin=SPIKE_MARGIN if spikes else 0.0))
        return rounded(rolled.select("ticker", "date", *columns), PANEL_DOUBLES)


# Each rolls only what it selects: Catalyst prunes the other window columns.
_feature_query("turnover_features", "turnover", "detrended_turnover", "turnover_zscore")
_feature_query("trailing_return_volatility", "trailing_return", "realized_volatility")
_feature_query("rolling_betas", "beta", "downside_beta", "relative_downside_beta")
_feature_query("lagged_crash_metrics", "lagged_ncskew", "lagged_duvol")
_feature_query(
    "controversy_features",
    "sector", "controversy_score", "controversy_change_4w", "controversy_change_13w", "controversy_change_26w",
    "controversy_rolling_mean_4w", "controversy_rolling_mean_13w", "controversy_rolling_mean_26w",
    "controversy_rolling_std_4w", "controversy_rolling_std_13w", "controversy_rolling_std_26w",
    "controversy_spike_flag",
)


@register(
    "crash_metrics_by_ticker",
    sql(
        """select ticker, n, case when n >= 3 and s2 > 0 then -(n * (n - 1) ** 1.5 * s3) / ((n - 1) * (n - 2) * s2 ** 1.5) end as ncskew,
        case when n >= 3 and v > 0 then cov / v end as beta
        from (select ticker, count(firm_specific_return) as n, sum(firm_specific_return ** 2) as s2, sum(firm_specific_return ** 3) as s3,
              covar_samp(weekly_return, benchmark_return) as cov,
              var_samp(case when weekly_return is not null then benchmark_return end) as v from known group by ticker)""",
        "known",
        rounded="ncskew beta",
    ),
)
def crash_metrics_by_ticker(spark, folder):
    """The same statistics as group aggregates."""
    from tailspark.functions import stats

    panel = features.base_panel(adapters.model_tables(spark, folder))
    grouped = panel.groupBy("ticker").agg(
        *stats.skew_parts(F.col("firm_specific_return"), "f"),
        *stats.beta_parts(F.col("weekly_return"), F.col("benchmark_return"), "b"),
    )
    return rounded(
        grouped.select(
            "ticker", F.col("f_n").alias("n"), stats.ncskew_from("f").alias("ncskew"), stats.beta_from("b").alias("beta")
        )
    )


@register(
    "sector_percentile",
    sql("select ticker, date, sector, controversy_sector_percentile from dataset", "dataset", rounded="controversy_sector_percentile"),
)
def sector_percentile(spark, folder):
    base = features.base_panel(adapters.model_tables(spark, folder)).select(
        "ticker", "date", F.coalesce("sector", F.lit("Unknown")).alias("sector"), "controversy_score"
    )
    return rounded(features.with_sector_percentile(stage(base, "scores")).drop("controversy_score"))


@register(
    "forward_targets",
    sql(
        "select ticker, date, future_ncskew, future_duvol, high_crash_risk from dataset",
        "dataset",
        rounded="future_ncskew future_duvol",
    ),
)
def forward_targets(spark, folder):
    """Forward metrics from a panel of returns, then the label by date."""
    base = features.base_panel(adapters.model_tables(spark, folder)).select("ticker", "date", "firm_specific_return")
    ahead = stage(features.with_forward_metrics(base), "forward")
    return rounded(features.with_labels(ahead).drop("firm_specific_return"))


@register(
    "label_thresholds",
    sql(
        "select date, quantile_cont(future_ncskew, 0.8) as threshold from dataset0 where future_ncskew is not null group by date",
        "dataset0",
        rounded="threshold",
    ),
)
def label_thresholds(spark, folder):
    return rounded(ranking.group_quantile(dataset(spark, folder), ["date"], "future_ncskew", 0.8, "threshold"))


@register("class_balance", sql("select high_crash_risk, count(*) as rows from labelled group by 1", "labelled"))
def class_balance(spark, folder):
    return evaluation.class_balance(dataset(spark, folder))


@register(
    "chronological_split",
    sql(
        "select s.split, count(*) as rows, count(distinct l.date) as dates, min(l.date) as first_date, max(l.date) as last_date from labelled l join splits s on l.date = s.date group by 1",
        "labelled",
        "splits",
    ),
)
def chronological_split(spark, folder):
    labelled = dataset(spark, folder).where(F.col("high_crash_risk").isNotNull())
    return (
        calendar.chronological_split(labelled)
        .groupBy("split")
        .agg(
            F.count("*").alias("rows"),
            F.count_distinct("date").alias("dates"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


# --- ranks, evaluation -------------------------------------------------------------


@register(
    "risk_buckets",
    sql(
        """select ticker, date, crash_probability,
        case when pos <= greatest(1, ceil(n * 0.2::double)) then 'High'
             when pos <= greatest(1, ceil(n * 0.2::double)) + ceil(n * 0.4::double) then 'Medium' else 'Low' end as risk_bucket
        from (select ticker, date, crash_probability, row_number() over (partition by date order by crash_probability desc, ticker) as pos,
              count(*) over (partition by date) as n from scored_panel)""",
        "scored_panel",
        rounded="crash_probability",
    ),
)
def risk_buckets(spark, folder):
    rows = scored_panel(spark, folder).select("ticker", "date", "crash_probability")
    return rounded(ranking.with_risk_bucket(rows))


@register("latest_scores", sql("select * from latest", "latest", rounded="crash_probability"))
def latest_scores_query(spark, folder):
    return rounded(latest_scores(spark, folder))


AUC_SQL = """select {keys}, sum(case when y = 1 then r end - 0.0) as rank_sum, sum(y) as pos, count(*) - sum(y) as neg
    from (select *, rank() over (partition by {keys} order by p) + (count(*) over (partition by {keys}, p) - 1) / 2.0 as r from rows_) group by {keys}"""


def _evaluation_sql(rows: str, keys: str) -> dict[str, str]:
    return {
        "rows_": rows,
        "auc": f"select {keys}, (rank_sum - pos * (pos + 1) / 2.0) / nullif(pos * neg, 0) as roc_auc from ({AUC_SQL.format(keys=keys)})",
        "placed": f"select *, row_number() over (partition by {keys} order by p desc, date, ticker) as pos, count(*) over (partition by {keys}) as n from rows_",
        "tops": f"""select {keys}, count(*) as n_rows, sum(y)::bigint as n_positive,
            count(*) filter (pos <= greatest(1, ceil(n * 0.2::double))) as top_bucket_size,
            (sum(case when pos <= greatest(1, ceil(n * 0.2::double)) then y else 0 end) / count(*) filter (pos <= greatest(1, ceil(n * 0.2::double))))::double as precision_at_top_bucket,
            (sum(case when pos <= greatest(1, ceil(n * 0.2::double)) then y else 0 end) / nullif(sum(y), 0))::double as crash_capture_at_top_bucket
            from placed group by {keys}""",
    }


_SPLIT_ROWS = "select ticker, date, split, high_crash_risk as y, crash_probability as p from scored"
_MODEL_ROWS = """select ticker, date, split, 'base' as model, high_crash_risk as y, base_probability as p from scored where split <> 'train'
    union all select ticker, date, split, 'full', high_crash_risk, crash_probability from scored where split <> 'train'"""


@register("roc_auc", sql("select * from auc", "scored", rounded="roc_auc", extra=_evaluation_sql(_SPLIT_ROWS, "split")))
def roc_auc(spark, folder):
    return rounded(evaluation.roc_auc(scored(spark, folder), ["split"]))


@register(
    "top_bucket",
    sql("select * from tops", "scored", rounded="precision_at_top_bucket crash_capture_at_top_bucket", extra=_evaluation_sql(_SPLIT_ROWS, "split")),
)
def top_bucket(spark, folder):
    return rounded(evaluation.top_bucket(scored(spark, folder), ["split"], 0.20))


_MODEL_SQL = _evaluation_sql(_MODEL_ROWS, "model, split")


@register(
    "split_evaluation",
    sql(
        "select t.*, a.roc_auc from tops t join auc a on t.model = a.model and t.split = a.split",
        "scored",
        rounded="precision_at_top_bucket crash_capture_at_top_bucket roc_auc",
        extra=_MODEL_SQL,
    ),
)
def split_evaluation(spark, folder):
    return rounded(evaluation.evaluate(two_models(spark, folder)))


@register(
    "model_deltas",
    sql(
        """select model, split, n_rows, n_positive, case model when 'base' then 1 else 2 end as feature_count, top_bucket_size,
                  roc_auc, precision_at_top_bucket, crash_capture_at_top_bucket from rep
        union all select 'full_minus_base', b.split, b.n_rows, b.n_positive, 1, b.top_bucket_size, b.roc_auc - a.roc_auc,
               b.precision_at_top_bucket - a.precision_at_top_bucket, b.crash_capture_at_top_bucket - a.crash_capture_at_top_bucket
        from rep a join rep b on a.split = b.split and a.model = 'base' and b.model = 'full'""",
        "scored",
        rounded="precision_at_top_bucket crash_capture_at_top_bucket roc_auc",
        extra=_MODEL_SQL | {"rep": "select t.*, a.roc_auc from tops t join auc a on t.model = a.model and t.split = a.split"},
    ),
)
def model_deltas(spark, folder):
    report = evaluation.evaluate(two_models(spark, folder)).withColumn(
        "feature_count", F.when(F.col("model") == "base", 1).otherwise(2)
    )
    return rounded(evaluation.with_deltas(stage(report, "report"), "base", "full", "full_minus_base"))


@register(
    "best_test_auc",
    sql("select max(roc_auc) as best_test_roc_auc from auc where split = 'test'", "scored", rounded="best_test_roc_auc", extra=_MODEL_SQL),
)
def best_test_auc(spark, folder):
    return rounded(evaluation.best_test_auc(evaluation.roc_auc(two_models(spark, folder), ["model", "split"])))


@register(
    "class_metrics",
    sql(
        """select c.split, a.roc_auc, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::double as f1
        from (select split, count(*) filter (y = 1 and p >= 0.5) as tp, count(*) filter (y = 0 and p >= 0.5) as fp,
              count(*) filter (y = 1 and p < 0.5) as fn from rows_ group by split) c join auc a on c.split = a.split""",
        "scored",
        rounded="roc_auc precision recall f1",
        extra=_evaluation_sql(_SPLIT_ROWS, "split"),
    ),
)
def class_metrics(spark, folder):
    return rounded(evaluation.class_metrics(scored(spark, folder)))


@register(
    "confusion",
    sql(
        """select 'test' as split, threshold, threshold_value, n_rows, tp, fp, tn, fn, (tp / nullif(tp + fp, 0))::double as precision,
        (tp / nullif(tp + fn, 0))::double as recall, (fp / nullif(fp + tn, 0))::double as false_positive_rate,
        (fn / nullif(fn + tp, 0))::double as false_negative_rate, ((tp + tn) / n_rows)::double as accuracy
        from (select threshold, threshold_value, count(*) as n_rows, count(*) filter (y = 1 and flag) as tp, count(*) filter (y = 0 and flag) as fp,
              count(*) filter (y = 0 and not flag) as tn, count(*) filter (y = 1 and not flag) as fn
              from (select y, 'probability_0_50' as threshold, 0.5::double as threshold_value, p >= 0.5 as flag from placed where split = 'test'
                    union all select y, 'top_20_percent', 0.2::double, pos <= greatest(1, ceil(n * 0.2::double)) from placed where split = 'test')
              group by 1, 2)""",
        "scored",
        rounded="threshold_value precision recall false_positive_rate false_negative_rate accuracy",
        extra=_evaluation_sql(_SPLIT_ROWS, "split"),
    ),
)
def confusion(spark, folder):
    return rounded(evaluation.confusion(scored(spark, folder)))


@register(
    "calibration",
    sql(
        """select 'test' as split, b.bin::int as bin, b.lo as probability_min, b.hi as probability_max, count(s.ticker) as n_rows,
        avg(s.crash_probability) as mean_predicted_probability, avg(s.high_crash_risk) as observed_crash_rate
        from (select i + 1 as bin, i * 0.2::double as lo, case when i = 4 then 1.0::double else (i + 1) * 0.2::double end as hi from range(5) t(i)) b
        left join (select * from scored where split = 'test') s on s.crash_probability >= b.lo and (s.crash_probability < b.hi or (b.bin = 5 and s.crash_probability <= 1))
        group by 1, 2, 3, 4""",
        "scored",
        rounded="probability_min probability_max mean_predicted_probability observed_crash_rate",
    ),
)
def calibration(spark, folder):
    return rounded(evaluation.calibration(scored(spark, folder)))


# --- portfolios --------------------------------------------------------------------

_OVERLAY = "date, return_date, strategy, benchmark, n_holdings, n_excluded"


@register("forward_overlay", sql(f"select {_OVERLAY} from overlay", "overlay", rounded="strategy benchmark"))
def forward_overlay(spark, folder):
    return rounded(portfolio.forward_overlay(scored_panel(spark, folder)))


@register(
    "forward_overlay_listed",
    sql(f"select {_OVERLAY}, excluded_tickers from overlay", "overlay", rounded="strategy benchmark"),
)
def forward_overlay_listed(spark, folder):
    return rounded(portfolio.forward_overlay(scored_panel(spark, folder), list_excluded=True))


@register(
    "excluded_names",
    sql("select date, ticker, crash_probability from buckets where high", "buckets", rounded="crash_probability"),
)
def excluded_names(spark, folder):
    return rounded(portfolio.excluded_names(scored_panel(spark, folder)))


LATEST_OVERLAY_SQL = """select e.date, coalesce(avg(case when coalesce(l.risk_bucket, 'Low') <> 'High' then e.weekly_return end), avg(e.weekly_return)) as strategy,
    avg(e.weekly_return) as benchmark from scored_panel e left join latest l on e.ticker = l.ticker
    where e.weekly_return is not null and e.date > (select date from panel_dates where place = floor(n * 0.6::double)) group by e.date"""


@register(
    "latest_score_overlay",
    sql(LATEST_OVERLAY_SQL, "scored_panel", "latest", "panel_dates", rounded="strategy benchmark"),
)
def latest_score_overlay(spark, folder):
    history = dataset(spark, folder).select("ticker", "date", "adj_close")
    return rounded(portfolio.latest_score_overlay(history, latest_scores(spark, folder)))


def _side_sql(side: str) -> dict[str, str]:
    rf = "(0.04::double / 52)"
    return {
        f"{side}_r": f"select date, 0.02 * (coalesce({side}, 0) - 1.5) as r from overlay",
        f"{side}_w": f"select date, r, product(1 + r) over (order by date) as w, row_number() over (order by r, date) as k, count(*) over () as n from {side}_r",
        f"{side}_p": f"select *, max(w) over (order by date) as peak from {side}_w",
        f"{side}_m": f"""select product(1 + r) ** (52.0 / count(*)) - 1 as annual,
            avg(r - {rf}) / stddev_samp(r - {rf}) * sqrt(52) as sharpe,
            avg(r - {rf}) / stddev_samp(case when r < {rf} then r - {rf} end) * sqrt(52) as sortino,
            min((w - peak) / peak) as drawdown, max(n) as n,
            -max(case when k = greatest(1, floor(n * (1.0::double - 0.95::double))) then r end) as var95,
            -avg(case when k <= greatest(1, floor(n * (1.0::double - 0.95::double))) then r end) as cvar95 from {side}_p""",
    }


BUSINESS_SQL = """select round(s.annual, 4) as strategy_annual_return, round(b.annual, 4) as benchmark_annual_return,
    round(s.annual - b.annual, 4) as alpha_annualized, round(s.sharpe, 3) as strategy_sharpe, round(b.sharpe, 3) as benchmark_sharpe,
    round(s.sortino, 3) as strategy_sortino, round(b.sortino, 3) as benchmark_sortino,
    round(s.drawdown, 4) as max_drawdown_strategy, round(b.drawdown, 4) as max_drawdown_benchmark,
    round(b.drawdown - s.drawdown, 4) as drawdown_improvement, round(s.var95, 4) as var_95_weekly, round(b.var95, 4) as benchmark_var_95_weekly,
    round(s.cvar95, 4) as cvar_95_weekly, round(b.cvar95, 4) as benchmark_cvar_95_weekly, s.n as evaluation_weeks,
    (select round(avg(n_excluded / (n_excluded + n_holdings)), 3) from overlay) as high_risk_excluded_pct,
    round((s.annual - b.annual) * 1e9 / 800000, 2) as team_roi, (s.annual - b.annual) * 1e9 > 800000 as justifies_team,
    0.0::double as benchmark_alpha_annualized, 0.0::double as benchmark_high_risk_excluded_pct, 0.0::double as benchmark_economic_gain_annual,
    1e9::double as fund_aum, 8e5::double as team_annual_cost, round((s.annual - b.annual) * 1e9, 0) as economic_gain_annual, '-' as benchmark_team_roi,
    'weekly_forward_overlay' as business_analysis_method, '{note}' as business_analysis_note
    from strategy_m s cross join benchmark_m b""".format(note=portfolio.NOTE)


def calm_overlay(spark, folder):
    """The overlay with its returns brought to the size of real weekly returns; line-item
    prices jump so far that compounding them for a year leaves the range of a double."""
    perf = portfolio.forward_overlay(scored_panel(spark, folder))
    return stage(
        perf.withColumns({side: 0.02 * (F.col(side) - 1.5) for side in ("strategy", "benchmark")}), "overlay"
    )


@register("business_summary", sql(BUSINESS_SQL, "overlay", extra=_side_sql("strategy") | _side_sql("benchmark")))
def business_summary(spark, folder):
    return portfolio.business_summary(calm_overlay(spark, folder))


BUSINESS_NAMES = (
    "strategy_annual_return benchmark_annual_return alpha_annualized benchmark_alpha_annualized strategy_sharpe benchmark_sharpe "
    "strategy_sortino benchmark_sortino max_drawdown_strategy max_drawdown_benchmark drawdown_improvement var_95_weekly "
    "benchmark_var_95_weekly cvar_95_weekly benchmark_cvar_95_weekly evaluation_weeks high_risk_excluded_pct "
    "benchmark_high_risk_excluded_pct business_analysis_method fund_aum economic_gain_annual benchmark_economic_gain_annual "
    "team_annual_cost team_roi benchmark_team_roi business_analysis_note"
).split()
# each entry as text: a truth value capitalised, a missing one as None
METRIC_SQL = "select unnest([{}, 'justifies_team']) as metric, unnest([{}, case when justifies_team then 'True' else 'False' end]) as value from ({})".format(
    ", ".join(f"'{n}'" for n in BUSINESS_NAMES),
    ", ".join(f"coalesce(cast({n} as varchar), 'None')" for n in BUSINESS_NAMES),
    BUSINESS_SQL,
)


@register("business_metric_rows", sql(METRIC_SQL, "overlay", extra=_side_sql("strategy") | _side_sql("benchmark")))
def business_metric_rows(spark, folder):
    """The same row as (metric, value) text."""
    return sinks.to_metric_rows(portfolio.business_summary(calm_overlay(spark, folder)))


QUARTER_PARTS = {
    "cut": "select date as cut_date from panel_dates where place = n - 14",
    "fwd": "select date from panel_dates where place > n - 14",
    "uni": """select ticker, crash_probability, row_number() over (order by crash_probability desc, ticker)
        <= greatest(1, ceil(count(*) over () * 0.2::double)) as high from scored_panel where date = (select cut_date from cut)""",
    "wk": """select p.date, coalesce(avg(case when not coalesce(u.high, false) then p.weekly_return end), avg(p.weekly_return)) as s, avg(p.weekly_return) as b
        from scored_panel p join fwd on p.date = fwd.date left join uni u on p.ticker = u.ticker where p.weekly_return is not null group by p.date""",
    "path": "select date, product(1 + s) over (order by date) as s, product(1 + b) over (order by date) as b from wk",
    "exc": """select u.ticker, round(u.crash_probability, 4) + 0.0 as crash_probability, p1.adj_close / p0.adj_close - 1 as q
        from uni u left join scored_panel p0 on u.ticker = p0.ticker and p0.date = (select cut_date from cut)
        left join scored_panel p1 on u.ticker = p1.ticker and p1.date = (select max(date) from fwd) where u.high""",
}


@register(
    "quarter_weekly",
    sql("select date, s as strategy_cumulative, b as benchmark_cumulative from path", "panel_dates", rounded="strategy_cumulative benchmark_cumulative", extra=QUARTER_PARTS),
)
def quarter_weekly(spark, folder):
    return rounded(portfolio.quarter_backtest(scored_panel(spark, folder))["weekly"])


@register(
    "quarter_excluded",
    sql(
        """select ticker, crash_probability, round(q, 4) + 0.0 as quarter_return,
        case when q < 0 then 'Avoided loss' when q is not null then 'Model missed' else 'No price data' end as outcome from exc""",
        "panel_dates",
        extra=QUARTER_PARTS,
    ),
)
def quarter_excluded(spark, folder):
    return rounded(portfolio.quarter_backtest(scored_panel(spark, folder))["excluded"])


@register(
    "quarter_excluded_with_return",
    sql("select ticker, crash_probability, round(q, 4) + 0.0 as quarter_return from exc where q is not null", "panel_dates", extra=QUARTER_PARTS),
)
def quarter_excluded_with_return(spark, folder):
    excluded = portfolio.quarter_backtest(scored_panel(spark, folder))["excluded"]
    return rounded(reports.excluded_with_return(excluded).drop("outcome"))


# of a fund of a billion, to the thousand
_DOLLARS = {"dollar_impact_quarter": -3, "dollar_impact_annualised": -3}


@register(
    "quarter_summary",
    sql(
        """select (select cut_date from cut) as cutoff_date,
        (select concat('Q', quarter(max(date)), ' ', year(max(date))) from fwd) as quarter_label, count(*) as forward_weeks,
        round(arg_max(s, date) - 1, 4) as strategy_quarter_return, round(arg_max(b, date) - 1, 4) as benchmark_quarter_return,
        round((arg_max(s, date) - arg_max(b, date)) * 10000)::int as outperformance_bps,
        round((arg_max(s, date) - arg_max(b, date)) * 1e9) as dollar_impact_quarter, round((arg_max(s, date) - arg_max(b, date)) * 4e9) as dollar_impact_annualised,
        (select count(*) from uni where high) as n_excluded, (select count(*) from uni where not high) as n_held,
        (select round(count(*) filter (round(q, 4) < 0) / nullif(count(q), 0), 4) from exc) as pct_excluded_correct from path""",
        "panel_dates",
        rounded=_DOLLARS,
        extra=QUARTER_PARTS,
    ),
)
def quarter_summary(spark, folder):
    return rounded(portfolio.quarter_backtest(scored_panel(spark, folder))["summary"], _DOLLARS)


# --- text --------------------------------------------------------------------------


@register(
    "text_scores",
    sql(
        """select text_id, neg as negative_word_count, pos as positive_word_count, kw as controversy_keyword_count, n as token_count,
        sentiment as text_sentiment_score, intensity as negative_sentiment_intensity, density as controversy_keyword_density,
        pressure::double as news_pressure_component from text_scored""",
        "text_scored",
        rounded="text_sentiment_score negative_sentiment_intensity controversy_keyword_density news_pressure_component",
    ),
)
def text_scores(spark, folder):
    return rounded(text.scored_texts(news(spark, folder), **LEXICON).drop("ticker", "date", "source", "text"))


TEXT_DOUBLES = (
    "text_sentiment_score negative_sentiment_intensity controversy_keyword_density news_pressure_component "
    "negative_esg_controversy_score_0_100 rolling_sentiment_13w"
)
_BAND = """case when negative_esg_controversy_score_0_100 >= 67 then 'High'
    when negative_esg_controversy_score_0_100 >= 34 then 'Medium' else 'Low' end as score_band"""


@register("weekly_text", sql(f"select *, {_BAND} from text_weekly", "text_weekly", rounded=TEXT_DOUBLES))
def weekly_text(spark, folder):
    return rounded(text.weekly_text(news(spark, folder), "documents", **LEXICON))


@register(
    "ticker_text_summary",
    sql(
        f"""select * exclude (date, k), date as latest_text_date from (select *, {_BAND},
        row_number() over (partition by ticker order by date desc) as k from text_weekly) where k = 1""",
        "text_weekly",
        rounded=TEXT_DOUBLES,
    ),
)
def ticker_text_summary(spark, folder):
    return rounded(text.ordered_ticker_summary(weekly_news(spark, folder)))


@register(
    "panel_with_text",
    sql(
        """select d.ticker, d.date, t.negative_esg_controversy_score_0_100, t.rolling_sentiment_13w, t.article_count as text_article_count
        from dataset0 d left join text_weekly t on d.ticker = t.ticker and d.date = t.date""",
        "dataset0",
        "text_weekly",
        rounded="negative_esg_controversy_score_0_100 rolling_sentiment_13w",
    ),
)
def panel_with_text(spark, folder):
    panel = dataset(spark, folder).select("ticker", "date")
    return rounded(text.attach_text_signals(panel, weekly_news(spark, folder)))


COVERAGE_PARTS = {
    "tagged": "select t.*, s.split from text_weekly t left join splits s on t.date = s.date",
    "each": "select 'overall' as split_name, * from tagged union all select split, * from tagged where split is not null",
    "hit": """select s.split, count(*) as n from labelled l join splits s on l.date = s.date
        join (select distinct ticker, date from text_weekly) t on l.ticker = t.ticker and l.date = t.date group by 1""",
}


@register(
    "text_coverage",
    sql(
        """select n.split, 'ok' as status, 'documents' as source_file, coalesce(sum(e.article_count), 0)::bigint as article_count,
        count(e.ticker) as weekly_text_rows, count(distinct e.ticker) as unique_tickers,
        coalesce(cast(min(e.date) as varchar), '') as date_start, coalesce(cast(max(e.date) as varchar), '') as date_end,
        round(sum(e.article_count) / nullif(count(distinct e.ticker), 0), 4) as avg_articles_per_ticker,
        coalesce(case when n.split = 'overall' then (select sum(n) from hit) else (select sum(n) from hit where hit.split = n.split) end, 0)::bigint as matched_model_rows
        from (values ('overall'), ('train'), ('validation'), ('test')) n(split) left join each e on n.split = e.split_name group by n.split""",
        "text_weekly",
        "labelled",
        "splits",
        extra=COVERAGE_PARTS,
    ),
)
def text_coverage(spark, folder):
    return rounded(text.text_coverage(weekly_news(spark, folder), dataset(spark, folder)))


@register(
    "text_kpis",
    sql(
        """select sum(article_count)::bigint as articles, avg(text_sentiment_score) as average_sentiment, sum(negative_word_count)::bigint as negative_words,
        sum(positive_word_count)::bigint as positive_words, sum(controversy_keyword_count)::bigint as controversy_keywords,
        count(distinct ticker) as tickers from text_weekly""",
        "text_weekly",
        rounded="average_sentiment",
    ),
)
def text_kpis(spark, folder):
    return rounded(reports.text_kpis(weekly_news(spark, folder)))


_STOP = ", ".join(f"'{w}'" for w in sorted({*text.words.STOP_WORDS, *text.words.PHRASE_STOP_WORDS}))
BIGRAM_PARTS = {
    "words": f"""select t.text_id, case when s.sentiment > 0 then 'bullish' else 'bearish' end as sentiment_bucket,
        list_filter(list_filter(regexp_split_to_array(lower(t.text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z]+')),
                    lambda w: w not in ({_STOP})) as w
        from news_text t join text_scored s on t.text_id = s.text_id where s.sentiment <> 0""",
    "pairs": """select text_id, sentiment_bucket, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1]))) as bigram
        from words where len(w) > 1""",
    "vocab": """select sentiment_bucket, bigram from (select sentiment_bucket, bigram,
        row_number() over (partition by sentiment_bucket order by count(*) desc, bigram) as k from pairs group by 1, 2) where k <= 2000""",
    "tf": "select p.sentiment_bucket, p.text_id, p.bigram, count(*) as tf from pairs p join vocab v using (sentiment_bucket, bigram) group by 1, 2, 3",
    "idf": """select f.sentiment_bucket, f.bigram, n.n, ln((1 + n.n) / (1 + f.df)) + 1 as idf
        from (select sentiment_bucket, bigram, count(*) as df from tf group by 1, 2) f
        join (select sentiment_bucket, count(*) as n from words group by 1) n using (sentiment_bucket)""",
    "unit": """select sentiment_bucket, bigram, n, tf * idf / sqrt(sum((tf * idf) ** 2) over (partition by sentiment_bucket, text_id)) as u
        from tf join idf using (sentiment_bucket, bigram)""",
    "mean_w": "select sentiment_bucket, bigram, sum(u) / max(n) as tfidf_weight from unit group by 1, 2",
}


@register(
    "bigram_terms",
    sql(
        """select sentiment_bucket, bigram, tfidf_weight from (select *, row_number() over (partition by sentiment_bucket order by round(tfidf_weight, 12) desc, bigram) as k from mean_w) where k <= 10""",
        "text_scored",
        rounded={"tfidf_weight": 8},
        extra=BIGRAM_PARTS,
    ),
)
def bigram_terms(spark, folder):
    own = sorted({*text.words.STOP_WORDS, *text.words.PHRASE_STOP_WORDS})
    return rounded(text.bigram_terms(news(spark, folder), own, **LEXICON), {"tfidf_weight": 8})


@register("topic_words")
def topic_words(spark, folder):
    return text.topics(news(spark, folder), "documents")["topic_words"]


@register("ticker_topics")
def ticker_topics(spark, folder):
    return text.topics(news(spark, folder), "documents")["ticker_topics"]


@register(
    "topic_certificate",
    sql(
        """select upper(trim(ticker)) as ticker, count(*) as article_count, cast(min(date) as varchar) as date_start, cast(max(date) as varchar) as date_end,
        true as shares_add_up, true as fixed_point, true as dominant_is_largest from news_text group by 1""",
        "news_text",
    ),
)
def topic_certificate(spark, folder):
    """Each ticker's shares against one more update from its words, and its dominant topic against its mean shares."""
    fitted = text.fit_topics(news(spark, folder))
    found = text.topic_tables(fitted, "documents")["ticker_topics"]
    names = [c for c in found.columns if c.startswith("topic_") and c != "topic_probability"]
    dominant = F.element_at(F.array(*names), F.substring("dominant_topic", 7, 3).cast("int"))
    largest = found.select(
        "ticker", ((dominant == F.greatest(*names)) & (dominant == F.col("topic_probability"))).alias("dominant_is_largest"),
        (F.abs(sum((F.col(n) for n in names), F.lit(0.0)) - 1) < 1e-9).alias("means_add_up"),
    )
    # a ticker whose texts have no words has no sum of its own, but means that add up like any other's
    each = F.coalesce(F.abs(F.col("shares_sum") - 1) < 1e-9, F.lit(True))
    return text.topic_certificate(fitted).join(largest, "ticker").select(
        "ticker", "article_count", "date_start", "date_end", (each & F.col("means_add_up")).alias("shares_add_up"),
        (F.col("step") < 1e-3).alias("fixed_point"), "dominant_is_largest",
    )


@register("topic_counts")
def topic_counts(spark, folder):
    return text.topic_counts(text.topics(news(spark, folder), "documents")["ticker_topics"])


# --- data quality ------------------------------------------------------------------


@shared
def dirty_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Raw prices with every row of the 28th twice."""
    raw = loaders.normalise_columns(raw_prices(spark, folder))
    return raw.withColumn("copy", F.explode(F.when(F.col("date").startswith("28-"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")


@shared
def dirty_benchmark(spark, folder):
    return raw_benchmark(spark, folder)


@shared
def dirty_fundamentals(spark, folder):
    return raw_fundamentals(spark, folder)


@shared
def dirty_controversies(spark, folder):
    return raw_controversies(spark, folder)


@shared
def stored_prices(spark, folder):
    """The raw prices, which the loader's votes, the counts and the loaded table all read."""
    return loaders.normalise_columns(raw_prices(spark, folder))


def dirty_tables(spark, folder):
    return {
        "prices": dirty_prices(spark, folder),
        "benchmark_prices": dirty_benchmark(spark, folder),
        "fundamentals": dirty_fundamentals(spark, folder),
        "controversies": dirty_controversies(spark, folder),
    }


def _log_line(dataset_name: str, check: str, value: str, rows: str, source: str) -> str:
    return (
        f"select '{dataset_name}' as dataset, '{check}' as \"check\", cast(({value}) as bigint) as v, "
        f"greatest(1, cast(({rows}) as bigint)) as d from {source}"
    )


# what a check's line says, by the check's name
_DETAIL_SQL = """case
    when "check" = 'missing_required_values' then 'Blank cells in required columns before loading.'
    when "check" = 'missing_required_rows' then 'Rows with at least one blank required cell before loading.'
    when "check" = 'duplicate_rows' then 'Fully repeated raw rows.'
    when "check" = 'rows_removed_or_invalid' then 'Rows the loader did not keep.'
    when "check" = 'negative_controversy_score' then 'Rows with a score below zero.'
    when "check" = 'duplicate_entity_date_rows' then concat('Repeated rows by ', case dataset when 'benchmark_prices' then 'date.' when 'fundamentals' then 'ticker, period_end.' else 'ticker, date.' end)
    when starts_with("check", 'invalid_') then concat('Rows whose ', replace(substr("check", 9), '_values', ''), ' is not a date.')
    when ends_with("check", '_numeric_coercion_failures') then concat('Filled ', replace("check", '_numeric_coercion_failures', ''), ' cells that are not numbers.')
    when starts_with("check", 'retained_missing_') then concat('Missing ', substr("check", 18), ' kept for median imputation.')
    when starts_with("check", 'zero_or_negative_') then concat('Rows with ', substr("check", 18), ' at or below zero.') end"""


def _cleaning_sql() -> str:
    twice = "select p.* from prices p, (values (1), (2)) c(k) where c.k = 1 or day(p.date) = 28"
    bad, gone = "day(date) = 15 and ticker like '%3'", "count(*) filter (day(date) = 28) / 2"
    lines = []
    add = lambda *a: lines.append(_log_line(*a))
    n = "count(*)"
    add("prices", "missing_required_values", "0", n + " * 4", "dirty")
    add("prices", "missing_required_rows", "0", n, "dirty")
    add("prices", "duplicate_rows", gone, n, "dirty")
    add("prices", "rows_removed_or_invalid", f"count(*) filter ({bad})", n, "dirty")
    add("prices", "invalid_date_values", "0", n, "dirty")
    add("prices", "duplicate_entity_date_rows", gone, n, "dirty")
    add("prices", "adj_close_numeric_coercion_failures", f"count(*) filter ({bad})", n, "dirty")
    add("prices", "volume_numeric_coercion_failures", "count(*) filter (day(date) = 20)", n, "dirty")
    add("prices", "zero_or_negative_adj_close", f"count(*) filter (adj_close <= 0 and not ({bad}))", n, "dirty")
    add("prices", "zero_or_negative_volume", "count(*) filter (volume <= 0 and day(date) <> 20)", n, "dirty")
    b, hole = "benchmark_prices", "count(*) filter (day(date) = 15)"
    add(b, "missing_required_values", hole, n + " * 2", b)
    add(b, "missing_required_rows", hole, n, b)
    add(b, "duplicate_rows", "0", n, b)
    add(b, "rows_removed_or_invalid", hole, n, b)
    add(b, "invalid_date_values", "0", n, b)
    add(b, "duplicate_entity_date_rows", "0", n, b)
    add(b, "benchmark_close_numeric_coercion_failures", "0", "count(*) filter (day(date) <> 15)", b)
    add(b, "zero_or_negative_benchmark_close", "count(*) filter (benchmark_close <= 0 and day(date) <> 15)", n, b)
    f, june = "fundamentals", "count(*) filter (month(period_end) = 6)"
    ratio = "count(*) - count(market_to_book)"
    add(f, "missing_required_values", ratio, n + " * 7", f)
    add(f, "missing_required_rows", ratio, n, f)
    add(f, "duplicate_rows", "0", n, f)
    add(f, "rows_removed_or_invalid", "0", n, f)
    add(f, "invalid_period_end_values", "0", n, f)
    add(f, "duplicate_entity_date_rows", "0", n, f)
    for c in ("market_cap", "shares_outstanding", "market_to_book", "leverage", "roa"):
        add(f, f"{c}_numeric_coercion_failures", june if c == "market_cap" else "0", "count(market_to_book)" if c == "market_to_book" else n, f)
    for c in ("market_cap", "shares_outstanding", "market_to_book", "leverage", "roa"):
        add(f, f"retained_missing_{c}", {"market_cap": june, "market_to_book": ratio}.get(c, "0"), n, f)
    add(f, "zero_or_negative_market_cap", "count(*) filter (market_cap <= 0 and month(period_end) <> 6)", n, f)
    add(f, "zero_or_negative_shares_outstanding", "count(*) filter (shares_outstanding <= 0)", n, f)
    c = "controversies"
    add(c, "missing_required_values", "0", n + " * 4", c)
    add(c, "missing_required_rows", "0", n, c)
    for check in ("duplicate_rows", "rows_removed_or_invalid", "invalid_date_values", "duplicate_entity_date_rows"):
        add(c, check, "0", n, c)
    add(c, "controversy_score_numeric_coercion_failures", "count(*) filter (month(date) = 1)", n, c)
    add(c, "negative_controversy_score", "0", n, c)
    body = " union all ".join(lines)
    fixed = """ union all select 'fundamentals', 'availability_lag_days', '45', null, null, 'Days after period_end until use.'
        union all select 'feature_engineering', 'date_alignment_method', 'weekly Friday observations', null, null, 'Daily rows are cut to Fridays.'
        union all select 'target_creation', 'future_window', 't+1 through t+13', null, null, 'Labels use later weeks only.'"""
    return sql(
        f'select dataset, "check", cast(v as varchar) as value, d as denominator, round(v / d * 100, 4) + 0.0 as percent, {_DETAIL_SQL} as detail from lines' + fixed,
        "prices",
        "benchmark_prices",
        "fundamentals",
        "controversies",
        extra={"dirty": twice, "lines": body},
    )


@register("cleaning_log", _cleaning_sql())
def cleaning_log(spark, folder):
    raw = dirty_tables(spark, folder)
    return rounded(quality.cleaning_log(raw, loaders.load_tables(spark, raw)))


_SUMMARY_DETAIL = {
    "raw_rows": "Rows before cleaning.",
    "loaded_rows": "Rows after parsing and required-field filtering.",
    "ticker_count": "Distinct tickers after loading.",
    "sector_count": "Distinct sectors after loading.",
    "date_start": "Earliest loaded date.",
    "date_end": "Latest loaded date.",
    ("feature_panel", "rows"): "Weekly ticker rows.",
    ("feature_panel", "ticker_count"): "Distinct tickers in the panel.",
    ("model_dataset", "rows"): "Rows with forward labels.",
    ("stock_scores", "rows"): "Scored names.",
}


def _summary_lines(section: str, source: str, **metrics: str) -> list[str]:
    return [
        f"select '{section}' as section, '{m}' as metric, cast({e} as varchar) as value, '{_SUMMARY_DETAIL.get((section, m)) or _SUMMARY_DETAIL[m]}' as detail from {source}"
        for m, e in metrics.items()
    ]


@register(
    "data_summary",
    sql(
        " union all ".join(
            _summary_lines("prices", "prices", raw_rows="count(*)", ticker_count="count(distinct ticker)", date_start="min(date)", date_end="max(date)")
            + _summary_lines("prices", "(" + LOADED_SQL["prices"] + ")", loaded_rows="count(*)")
            + _summary_lines("benchmark_prices", "benchmark_prices", raw_rows="count(*)", date_start="min(date)", date_end="max(date)")
            + _summary_lines("benchmark_prices", "(" + LOADED_SQL["benchmark_prices"] + ")", loaded_rows="count(*)")
            + _summary_lines("fundamentals", "fundamentals", raw_rows="count(*)", loaded_rows="count(*)", ticker_count="count(distinct ticker)", date_start="min(period_end)", date_end="max(period_end)")
            + _summary_lines("controversies", "controversies", raw_rows="count(*)", loaded_rows="count(*)", ticker_count="count(distinct ticker)", sector_count="count(distinct sector)", date_start="min(date)", date_end="max(date)")
            + _summary_lines("feature_panel", "dataset", rows="count(*)", ticker_count="count(distinct ticker)")
            + _summary_lines("model_dataset", "dataset", rows="count(*)")
            + _summary_lines("stock_scores", "latest", rows="count(*)")
            + [
                f"select '{name}', 'source_file', '{name}.parquet', 'Input of this run.'"
                for name in ("prices", "benchmark_prices", "fundamentals", "controversies")
            ]
            + ["select 'configuration', 'fundamentals_lag_days', '45', 'Availability lag.' union all select 'configuration', 'target_horizon_weeks', '13', 'Forward label window.'"]
        ),
        "prices",
        "benchmark_prices",
        "fundamentals",
        "controversies",
        "dataset",
        "latest",
    ),
)
def data_summary(spark, folder):
    raw = dirty_tables(spark, folder) | {"prices": stored_prices(spark, folder)}
    rows = panel_scores(spark, folder)
    files = {name: f"{folder}/raw/{name}.parquet" for name in raw}
    return quality.data_summary(raw, loaders.load_tables(spark, raw), rows, rows, latest_scores(spark, folder), files)


# --- reports -----------------------------------------------------------------------


@register(
    "descriptive_stats",
    sql(
        " union all ".join(
            f"""select '{f}' as feature, '{feature_group(f)}' as feature_group, count({f}) as count, avg({f})::double as mean, stddev_samp({f}) as std,
            min({f})::double as min, max({f})::double as max, count(*) - count({f}) as null_count,
            round((count(*) - count({f})) / count(*) * 100, 4) as null_percent from dataset"""
            for f in FEATURES
        ),
        "dataset",
        rounded={"mean": 4, "std": 4, "min": 4, "max": 4, "null_percent": 4},
    ),
)
def descriptive_stats(spark, folder):
    return rounded(
        reports.descriptive_stats(dataset(spark, folder)), {c: 4 for c in ("mean", "std", "min", "max", "null_percent")}
    )


@register(
    "correlation_matrix",
    sql(
        " union all ".join(
            f"select '{a}' as feature, " + ", ".join(f"corr({a}, {b}) as {b}" for b in FEATURES) + " from dataset"
            for a in FEATURES
        ),
        "dataset",
        rounded=" ".join(FEATURES),
    ),
)
def correlation_matrix(spark, folder):
    return rounded(reports.correlation_matrix(dataset(spark, folder)))


@register(
    "sector_controversy",
    sql(
        "select sector, avg(controversy_score) as controversy_score from dataset where controversy_score is not null group by 1 order by 2 desc, 1 limit 10",
        "dataset",
        rounded="controversy_score",
    ),
)
def sector_controversy(spark, folder):
    return rounded(reports.sector_controversy(dataset(spark, folder)))


@register(
    "controversy_over_time",
    sql(
        "select date, avg(controversy_score) as controversy_score from dataset where controversy_score is not null group by 1",
        "dataset",
        rounded="controversy_score",
    ),
)
def controversy_over_time(spark, folder):
    return rounded(reports.controversy_over_time(dataset(spark, folder)))


@register(
    "price_history",
    sql(
        "select ticker, date, adj_close from (select *, row_number() over (partition by ticker order by date desc) as k from weekly) where k <= 104",
        "weekly",
        rounded="adj_close",
    ),
)
def price_history(spark, folder):
    return rounded(reports.price_history(dataset(spark, folder)))


@register(
    "recent_prices",
    sql(
        "select ticker, date, adj_close from weekly where ticker = 'S7' and adj_close > 0 order by date desc limit 52",
        "weekly",
        rounded="adj_close",
    ),
)
def recent_prices(spark, folder):
    return rounded(reports.recent_prices(resample.weekly_prices(adapters.prices(spark, folder)), "S7"))


@register(
    "price_scenarios",
    sql(
        """select l.ticker, l.as_of_date, p.adj_close as latest_price, 13 as horizon_weeks,
        p.adj_close * exp(-0.02 * v * (1 + l.crash_probability)) as price_p05, p.adj_close as price_p50, p.adj_close * exp(0.02 * v) as price_p95,
        l.crash_probability, l.risk_bucket, 'historical_volatility_crash_adjusted' as scenario_method
        from latest l join (select *, coalesce(realized_volatility, 0) / sqrt(52) * sqrt(13) as v,
                            row_number() over (partition by ticker order by date desc) as k from dataset0) p on l.ticker = p.ticker and p.k = 1""",
        "latest",
        "dataset0",
        rounded="crash_probability",
        digits="latest_price price_p05 price_p50 price_p95",
    ),
)
def price_scenarios(spark, folder):
    """A small z, as the volatility of line-item prices is some hundred times that of stocks. A price may still reach
    1e10 and more, where six places are beyond a double: prices are compared to ten digits, six places at most."""
    found = reports.price_scenarios(dataset(spark, folder), latest_scores(spark, folder), z=0.02)
    cut = rounded_to_digits(found, ("latest_price", "price_p05", "price_p50", "price_p95"))
    return cut.withColumn("crash_probability", F.floor(F.col("crash_probability") * 1e6 + 0.5137) / 1e6)


TICKERS_SQL = """select ticker, min(tier)::int as tier from (
    (select ticker, 0 as tier, crash_probability as p from latest where risk_bucket = 'High' order by crash_probability desc, ticker limit 2)
    union all (select ticker, 1, crash_probability from latest where risk_bucket = 'Low' order by crash_probability, ticker limit 2)
    union all (select ticker, 2, -crash_probability from latest order by crash_probability desc, ticker limit 4)) group by ticker order by tier, min(p) limit 4"""


@register("representative_tickers", sql(TICKERS_SQL, "latest"))
def representative_tickers(spark, folder):
    return reports.representative_tickers(latest_scores(spark, folder))


@register(
    "representative_prices",
    sql(f"select ticker, date, adj_close from weekly where ticker in (select ticker from ({TICKERS_SQL}))", "weekly", "latest", rounded="adj_close"),
)
def representative_prices(spark, folder):
    return rounded(reports.representative_prices(dataset(spark, folder), latest_scores(spark, folder)))


@register(
    "high_risk_history",
    sql(
        """select ticker, date, controversy_score from dataset where ticker in
        (select ticker from latest where risk_bucket = 'High' order by crash_probability desc, ticker limit 5)""",
        "dataset",
        "latest",
        rounded="controversy_score",
    ),
)
def high_risk_history(spark, folder):
    return rounded(reports.high_risk_history(dataset(spark, folder), latest_scores(spark, folder)))


@register(
    "top_scores",
    sql("select * from latest order by crash_probability desc, ticker limit 10", "latest", rounded="crash_probability"),
)
def top_scores(spark, folder):
    return rounded(reports.top_scores(latest_scores(spark, folder)))


@register(
    "ranked_scores",
    sql("select *, row_number() over (order by crash_probability desc, ticker) as place from latest", "latest", rounded="crash_probability"),
)
def ranked_scores(spark, folder):
    return rounded(reports.ranked_scores(latest_scores(spark, folder)))


@register(
    "filtered_scores",
    sql("select * from latest where risk_bucket = 'Medium' and contains(ticker, 'S5')", "latest", rounded="crash_probability"),
)
def filtered_scores(spark, folder):
    shouted = latest_scores(spark, folder).withColumn("risk_bucket", F.upper("risk_bucket"))
    return rounded(reports.filtered_scores(shouted, "Medium", " s5 "))


@register(
    "score_kpis",
    sql(
        """select count(*) as names, count(*) filter (risk_bucket = 'High') as high_names, avg(crash_probability) as average_probability,
        max(as_of_date) as as_of_date from latest""",
        "latest",
        rounded="average_probability",
    ),
)
def score_kpis(spark, folder):
    return rounded(reports.score_kpis(latest_scores(spark, folder)))


def label_correlation(spark, folder):
    """An importance per feature that SQL can repeat: its absolute correlation with the label."""
    rows = dataset(spark, folder).where(F.col("high_crash_risk").isNotNull())
    one = rows.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col("high_crash_risk").cast("double"))).alias(f) for f in FEATURES])
    return one.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 9).alias("importance")) for f in FEATURES]))
    )


IMPORTANCE_PARTS = {
    "imp": " union all ".join(
        f"select '{f}' as feature, round(abs(corr({f}, high_crash_risk)), 9) as importance from labelled" for f in FEATURES
    ),
    "top15": "select *, importance / sum(importance) over () * 100 as share_percent from (select * from imp order by importance desc, feature limit 15)",
}


@register(
    "importance_percents",
    sql(
        """select feature, importance, share_percent, (floor(share_percent) + case when row_number() over (order by share_percent - floor(share_percent) desc, importance desc, feature)
        <= 100 - sum(floor(share_percent)) over () then 1 else 0 end)::bigint as percent from top15""",
        "labelled",
        rounded="importance share_percent",
        extra=IMPORTANCE_PARTS,
    ),
)
def importance_percents(spark, folder):
    return rounded(reports.importance_percents(label_correlation(spark, folder)))


def summary_views(spark, folder):
    panel = dataset(spark, folder)
    return {
        "raw_prices": adapters.prices(spark, folder),
        "raw_controversies": adapters.controversies(spark, folder),
        "model_dataset": panel,
        "stock_scores": reports.with_sector(latest_scores(spark, folder), panel),
    }


_SQL_VIEWS = {
    "observations_by_ticker": sql(
        "select ticker, count(*) as observations, min(date) as start_date, max(date) as end_date from prices group by 1 order by 2 desc, 1 limit 20", "prices"
    ),
    "sector_controversy_summary": sql(
        "select sector, count(distinct ticker) as tickers, count(*) as records, avg(controversy_score) as avg_controversy_score from controversies group by 1",
        "controversies",
        rounded="avg_controversy_score",
    ),
    "top_controversy_events": sql(
        "select ticker, date, sector, controversy_score from controversies order by controversy_score desc, ticker, date limit 10",
        "controversies",
        rounded="controversy_score",
    ),
    "target_class_balance": sql("select high_crash_risk, count(*) as rows from dataset group by 1", "dataset"),
    "high_risk_names_by_sector": sql(
        """select coalesce(p.sector, 'Unknown') as sector, count(*) as high_risk_names, avg(l.crash_probability) as avg_crash_probability
        from latest l left join (select ticker, arg_max(sector, date) as sector from dataset group by 1) p on l.ticker = p.ticker
        where l.risk_bucket = 'High' group by 1""",
        "latest",
        "dataset",
        rounded="avg_crash_probability",
    ),
    "model_feature_missingness": sql(
        """select count(*) as rows, count(*) - count(lagged_ncskew) as missing_lagged_ncskew, count(*) - count(downside_beta) as missing_downside_beta,
        count(*) - count(controversy_score) as missing_controversy_score, count(*) - count(market_cap) as missing_market_cap from dataset""",
        "dataset",
    ),
}


def _summary_query(name: str) -> None:
    @register(f"sql_{name}", _SQL_VIEWS[name])
    def query(spark, folder):
        return rounded(reports.summary_query(name, summary_views(spark, folder)))


for _name in _SQL_VIEWS:
    _summary_query(_name)


@register(
    "sql_summary",
    sql(
        " union all ".join(
            f"select '{name}' as query_name, count(*) as row_count, count(*) as json_rows from ({body})"
            for name, body in {
                "observations_by_ticker": "select distinct ticker from prices limit 20",
                "sector_controversy_summary": "select distinct sector from controversies",
                "top_controversy_events": "select 1 from controversies limit 10",
                "target_class_balance": "select high_crash_risk from dataset group by 1",
                "high_risk_names_by_sector": """select coalesce(p.sector, 'Unknown') from latest l left join (select ticker, arg_max(sector, date) as sector
                    from dataset group by 1) p on l.ticker = p.ticker where l.risk_bucket = 'High' group by 1""",
                "model_feature_missingness": "select 1",
            }.items()
        ),
        "prices",
        "controversies",
        "dataset",
        "latest",
    ),
)
def sql_summary(spark, folder):
    """Each result as JSON in one cell; the JSON is read back to count its records."""
    summary = reports.sql_summary(summary_views(spark, folder))
    records = F.from_json("result_json", "array<map<string, string>>")
    return summary.select("query_name", "row_count", F.size(records).cast("bigint").alias("json_rows"))


DOWNSIDE_SQL = {
    "monthly": MONTHLY_SQL,
    "fut": """select *, lead(adj_close, 3) over t / adj_close - 1 as future_return_3m,
        case when lead(date, 2) over t is not null then min(adj_close) over (partition by ticker order by date rows between 1 following and 3 following) end as future_min_3m
        from monthly window t as (partition by ticker order by date)""",
    "dd": "select *, future_min_3m / adj_close - 1 as future_drawdown_3m from fut",
    "rk": """select *, case when future_return_3m is not null then (rank() over (partition by date order by -future_return_3m nulls last)
          + (count(*) over (partition by date, future_return_3m) - 1) / 2.0) / count(future_return_3m) over (partition by date) end as loss_rank,
        case when future_drawdown_3m is not null then (rank() over (partition by date order by -future_drawdown_3m nulls last)
          + (count(*) over (partition by date, future_drawdown_3m) - 1) / 2.0) / count(future_drawdown_3m) over (partition by date) end as drawdown_rank from dd""",
}


@register(
    "forward_downside_signal",
    sql(
        """select *, least(greatest(0.6 * loss_rank + 0.4 * drawdown_rank, 0), 1)::double as future_downside_signal
        from rk where loss_rank is not null and drawdown_rank is not null""",
        "prices",
        rounded="adj_close future_return_3m future_min_3m future_drawdown_3m loss_rank drawdown_rank future_downside_signal",
        extra=DOWNSIDE_SQL,
    ),
)
def forward_downside_signal(spark, folder):
    return rounded(downside.forward_downside_signal(adapters.prices(spark, folder)))


# --- models ------------------------------------------------------------------------


PREPARED_SQL = " union all ".join(
    f"""select '{f}' as feature, coalesce(m, 0)::double as median, avg(x) as mean, coalesce(nullif(stddev_pop(x), 0), 1) as scale
    from (select m, coalesce({f}, m, 0)::double as x from labelled, (select quantile_cont({f}, 0.5) as m from labelled)) group by m"""
    for f in FEATURES
)


@shared
def model_rows(spark, folder):
    """What the models read of every panel row."""
    return panel(spark, folder).select(
        "ticker", "date", "high_crash_risk", "adj_close", "weekly_return", *[F.col(f).cast("double").alias(f) for f in FEATURES]
    )


def training_rows(spark, folder):
    return model_rows(spark, folder).where(F.col("high_crash_risk").isNotNull()).select("ticker", "date", "high_crash_risk", *FEATURES)


@shared
def skew_rows(spark, folder):
    """The labelled rows with one feature."""
    return panel(spark, folder).where(F.col("high_crash_risk").isNotNull()).select("ticker", "date", "high_crash_risk", "lagged_ncskew")


@register(
    "prepared_statistics",
    sql(PREPARED_SQL, "labelled", rounded={"median": 4, "mean": 4, "scale": 4}),
)
def prepared_statistics(spark, folder):
    """Exact medians, means and scales of the model features over all labelled rows."""
    found = modelling.fit_preparation(training_rows(spark, folder), FEATURES)
    rows = list(zip(found.features, found.median, found.mean, found.scale))
    table = spark.createDataFrame(rows, "feature string, median double, mean double, scale double")
    return rounded(table, {"median": 4, "mean": 4, "scale": 4})


@register(
    "exact_medians",
    sql(
        " union all ".join(f"select '{c}' as name, quantile_cont({c}, 0.5)::double as median from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
        rounded="median",
    ),
)
def exact_medians(spark, folder):
    """Brackets of a coarse sketch, counted exactly."""
    from tailspark.operators.selection import exact_medians as medians

    names = ("l_quantity", "l_extendedprice", "l_discount")
    found = medians(adapters.table(spark, folder, "lineitem"), names, error=0.01)
    return rounded(spark.createDataFrame(list(found.items()), "name string, median double"))


def _fitted(spark, folder) -> modelling.FittedModel:
    return modelling.fit(training_rows(spark, folder), FEATURES)


_NEWTON_ROWS = """select (coalesce(l.lagged_ncskew, p.median) - p.mean) / p.scale as x, l.high_crash_risk::double as y,
    n.rows / (2.0::double * case when l.high_crash_risk = 1 then n.ones else n.rows - n.ones end) as w
    from labelled l, (select * from prep where feature = 'lagged_ncskew') p, (select count(*)::double as rows, sum(high_crash_risk)::double as ones from labelled) n"""
# weighted logistic regression with C = 1 by Newton steps from zero
_NEWTON = """select 0 as i, 0.0::double as a, 0.0::double as b union all
    select i + 1, a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) from (
      select i, a, b, sum(w * (p - y)) as g1, sum(w * (p - y) * x) + b as g2, sum(w * p * (1 - p)) as h11, sum(w * p * (1 - p) * x) as h12, sum(w * p * (1 - p) * x * x) + 1 as h22
      from (select n.i, n.a, n.b, r.x, r.y, r.w, 1 / (1 + exp(-(n.a + n.b * r.x))) as p from newton n, newton_rows r where n.i < 12) group by i, a, b)"""


def _newton_sql(select: str, rounded: dict[str, int]) -> str:
    text_ = sql(select, "labelled", rounded=rounded, extra={"prep": PREPARED_SQL, "newton_rows": _NEWTON_ROWS, "newton": _NEWTON, "fitted": "select a, b from newton where i = 12"})
    return text_.replace("with ", "with recursive ", 1)


def _one_feature(spark, folder) -> modelling.FittedModel:
    return modelling.fit(skew_rows(spark, folder), ("lagged_ncskew",))


@register("one_feature_fit", _newton_sql("select a as intercept, b as coefficient from fitted", {"intercept": 3, "coefficient": 3}))
def one_feature_fit(spark, folder):
    """The weighted, penalised fit on one feature; SQL finds it by Newton steps."""
    fitted = _one_feature(spark, folder).classifier
    table = spark.createDataFrame([(float(fitted.intercept), float(fitted.coefficients[0]))], "intercept double, coefficient double")
    return rounded(table, {"intercept": 3, "coefficient": 3})


@register(
    "one_feature_scores",
    _newton_sql(
        """select ticker, as_of_date, crash_probability, case when place <= greatest(1, ceil(n * 0.2::double)) then 'High'
        when place <= greatest(1, ceil(n * 0.2::double)) + ceil(n * 0.4::double) then 'Medium' else 'Low' end as risk_bucket, 'lagged_ncskew' as top_drivers
        from (select *, row_number() over (order by crash_probability desc, ticker) as place, count(*) over () as n from (
          select d.ticker, cast(d.date as varchar) as as_of_date, 1 / (1 + exp(-(a + b * (coalesce(d.lagged_ncskew, p.median) - p.mean) / p.scale))) as crash_probability
          from dataset d, fitted, (select * from prep where feature = 'lagged_ncskew') p where d.date = (select max(date) from dataset)))""",
        {"crash_probability": 3},
    ),
)
def one_feature_scores(spark, folder):
    """Scores, buckets and drivers of the newest date from that fit."""
    return rounded(modelling.score_latest(_one_feature(spark, folder), dataset(spark, folder)), {"crash_probability": 3})


def settled_labels(statement: str) -> str:
    """The same statement with labels that do not depend on the order of sums, as `panel` has them."""
    bound = "quantile_cont(future_ncskew, 0.8) over (partition by date)"
    assert bound in statement
    return settled(statement.replace(bound, f"{bound} - {LABEL_MARGIN}"))


@register(
    "fit_certificate",
    settled_labels(sql(
        "select f.term, n.rows, n.ones, true as stationary from (select unnest(['intercept', " + ", ".join(f"'{f}'" for f in FEATURES) + "]) as term) f, (select count(*) as rows, sum(high_crash_risk)::bigint as ones from labelled) n",
        "labelled",
    )),
)
def fit_certificate(spark, folder):
    """Whether each term of the full model stands at the optimum: its gradient is below a bound set beforehand."""
    rows = training_rows(spark, folder)
    counts = rows.agg(F.count("*").alias("rows"), F.sum("high_crash_risk").cast("long").alias("ones"))
    found = modelling.optimality(_fitted(spark, folder), rows)
    return found.select("term", (F.abs("gradient") < 1e-6).alias("stationary")).crossJoin(F.broadcast(counts))


@register("train_metrics")
def train_metrics(spark, folder):
    return modelling.train_classifier(panel(spark, folder)).metrics


@register("model_scores")
def model_scores(spark, folder):
    return modelling.score_latest(_fitted(spark, folder), dataset(spark, folder))


@register("model_scores_as_of")
def model_scores_as_of(spark, folder):
    return modelling.score_latest(_fitted(spark, folder), dataset(spark, folder), as_of="1999-01-01")


@register("feature_importance")
def feature_importance(spark, folder):
    return spark.createDataFrame(_fitted(spark, folder).importances(), "feature string, importance double")


@register("esg_lift")
def esg_lift(spark, folder):
    return modelling.compare_esg_lift(panel(spark, folder))


@register("text_lift")
def text_lift(spark, folder):
    return modelling.compare_text_lift(text.attach_text_signals(panel(spark, folder), weekly_news(spark, folder)))


@register("algorithm_comparison")
def algorithm_comparison(spark, folder):
    return modelling.compare_algorithms(panel(spark, folder))


@register("tuning_results")
def tuning_results(spark, folder):
    """The search over the grids of all three learners."""
    return modelling.tuning_results(panel(spark, folder), run_search=True)


@register("test_confusion")
def test_confusion(spark, folder):
    return modelling.test_diagnostics(panel(spark, folder))["confusion"]


@register("test_calibration")
def test_calibration(spark, folder):
    return modelling.test_diagnostics(panel(spark, folder))["calibration"]


@register("model_overlay")
def model_overlay(spark, folder):
    scored_rows = modelling.score_panel(_fitted(spark, folder), dataset(spark, folder))
    return portfolio.forward_overlay(scored_rows)


@register("model_quarter_summary")
def model_quarter_summary(spark, folder):
    # whether a row has a feature at all is one column
    rows = model_rows(spark, folder).withColumn("any_feature", F.coalesce(*FEATURES))
    scored_rows = modelling.score_panel(_fitted(spark, folder), rows, ("ticker", "date", "adj_close", "weekly_return", "any_feature"))
    return portfolio.quarter_backtest(scored_rows, features=("any_feature",))["summary"]


_DRIVER_WEIGHTS = {f: (i % 7 - 3) / 2.0 + 0.25 for i, f in enumerate(FEATURES)}


@register(
    "top_drivers",
    sql(
        """select ticker, date, string_agg(feature, ';' order by k) as top_drivers from (
        select r.ticker, r.date, r.feature, row_number() over (partition by r.ticker, r.date order by abs((coalesce(r.x, p.median) - p.mean) / p.scale * r.c) desc, r.i desc) as k
        from long_rows r join prep p on r.feature = p.feature) where k <= 3 group by 1, 2""",
        "labelled",
        extra={
            "prep": PREPARED_SQL,
            "long_rows": " union all ".join(
                f"select ticker, date, '{f}' as feature, {i} as i, {c}::double as c, {f}::double as x from labelled"
                for i, (f, c) in enumerate(_DRIVER_WEIGHTS.items())
            ),
        },
    ),
)
def top_drivers(spark, folder):
    """The three largest contributions of every labelled row under fixed coefficients."""

    class Fixed:
        coefficients = Vectors.dense(list(_DRIVER_WEIGHTS.values()))

    rows = training_rows(spark, folder)
    model = modelling.FittedModel("logistic_regression", modelling.fit_preparation(rows, FEATURES), Fixed())
    return rows.select("ticker", "date", model.top_drivers().alias("top_drivers"))


# --- variants of the older script --------------------------------------------------


@register(
    "variant_empty_weeks",
    sql(
        """select g.ticker, g.date, w.adj_close, coalesce(w.weekly_volume, 0) as weekly_volume,
        last_value(w.adj_close ignore nulls) over (partition by g.ticker order by g.date) /
          last_value(w.adj_close ignore nulls) over (partition by g.ticker order by g.date rows between unbounded preceding and 1 preceding) - 1 as weekly_return
        from (select ticker, cast(unnest(generate_series(min(date), max(date), interval 7 day)) as date) as date from weekly group by ticker) g
        left join weekly w on g.ticker = w.ticker and g.date = w.date""",
        "weekly",
        rounded="adj_close weekly_volume weekly_return",
    ),
)
def variant_empty_weeks(spark, folder):
    return rounded(variants.weekly_with_empty_weeks(adapters.prices(spark, folder)))


@register(
    "variant_static_fundamentals",
    sql(
        """select w.ticker, w.date, w.adj_close * f.shares_outstanding as market_cap, f.shares_outstanding, f.market_to_book, f.leverage, f.roa
        from weekly w left join (select ticker, arg_max(shares_outstanding, period_end) as shares_outstanding, arg_max(market_to_book, period_end) as market_to_book,
          arg_max(leverage, period_end) as leverage, arg_max(roa, period_end) as roa from fundamentals group by 1) f on w.ticker = f.ticker""",
        "weekly",
        "fundamentals",
        rounded=doubles("market_cap", "shares_outstanding", "market_to_book", "leverage", "roa"),
    ),
)
def variant_static_fundamentals(spark, folder):
    panel = dataset(spark, folder).select("ticker", "date", "adj_close")
    joined = variants.static_fundamentals(panel, adapters.fundamentals(spark, folder))
    return rounded(joined.drop("adj_close"), PANEL_DOUBLES)


@register(
    "variant_first_sector",
    sql(
        "select w.ticker, w.date, c.sector from weekly w left join (select ticker, arg_min(sector, date) as sector from controversies group by 1) c on w.ticker = c.ticker",
        "weekly",
        "controversies",
    ),
)
def variant_first_sector(spark, folder):
    panel = dataset(spark, folder).select("ticker", "date", "sector")
    return variants.first_sector(panel, adapters.controversies(spark, folder))


@register(
    "variant_turnover",
    sql(
        """select ticker, date, case when count(turnover) over w >= 4 then turnover - avg(turnover) over w end as detrended_turnover
        from known window w as (partition by ticker order by date rows between 25 preceding and current row)""",
        "known",
        rounded="detrended_turnover",
    ),
)
def variant_turnover(spark, folder):
    panel = dataset(spark, folder).select("ticker", "date", "turnover")
    return rounded(variants.turnover_from_four(panel).drop("turnover"))


@register(
    "variant_full_betas",
    sql(
        """select ticker, date, case when rows_ = 26 and b_n = 26 and b_var > 0 then b_cov / b_var end as beta_full_window,
        case when rows_ = 26 and d_n = falls and d_n >= 3 and d_var > 0 then d_cov / d_var end as downside_beta_full_window
        from (select *, count(*) over w as rows_, count(case when benchmark_return < 0 then 1 end) over w as falls from windows
              window w as (partition by ticker order by date rows between 25 preceding and current row))""",
        "windows",
        rounded="beta_full_window downside_beta_full_window",
    ),
)
def variant_full_betas(spark, folder):
    panel = dataset(spark, folder).select("ticker", "date", "weekly_return", "benchmark_return")
    return rounded(variants.full_window_betas(panel).drop("weekly_return", "benchmark_return"))


@register(
    "variant_split",
    sql(
        """select split, count(*) as rows, min(date) as first_date from (select l.date, case when d.place < floor(d.n * 0.6::double) then 'train'
        when d.place < floor(d.n * 0.8::double) then 'validation' else 'test' end as split from labelled l join dated d on l.date = d.date) group by 1""",
        "labelled",
        "dated",
    ),
)
def variant_split(spark, folder):
    rows = training_rows(spark, folder).select("ticker", "date")
    return variants.split_by_cut_dates(rows).groupBy("split").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date")
    )


@register(
    "variant_buckets",
    sql(
        """select ticker, date, sector, case when pos <= ceil(n * 0.2::double) then 'High' when pos <= ceil(n * 0.6::double) then 'Medium' else 'Low' end as risk_bucket
        from (select ticker, date, sector, row_number() over (partition by date order by crash_probability desc, ticker) as pos, count(*) over (partition by date) as n from scored_panel)""",
        "scored_panel",
    ),
)
def variant_buckets(spark, folder):
    rows = panel_scores(spark, folder).select("ticker", "date", "sector", "crash_probability")
    return variants.buckets_by_position(rows).drop("crash_probability")


@register(
    "variant_quarter_excluded",
    sql(
        """select e.ticker, e.crash_probability, round(f.p1 / f.p0 - 1, 4) + 0.0 as quarter_return,
        case when f.p1 / f.p0 - 1 < 0 then 'Avoided loss' else 'Model missed' end as outcome from exc e left join
        (select p.ticker, arg_min(p.adj_close, p.date) as p0, arg_max(p.adj_close, p.date) as p1 from scored_panel p join fwd on p.date = fwd.date group by 1) f
        on e.ticker = f.ticker""",
        "panel_dates",
        extra=QUARTER_PARTS,
    ),
)
def variant_quarter_excluded(spark, folder):
    return rounded(variants.script_quarter(scored_panel(spark, folder))["excluded"])


@register(
    "variant_quarter_weekly",
    sql(
        """select path.date, path.s as strategy_cumulative, path.b as benchmark_cumulative, wk.s as strategy_weekly_return, wk.b as benchmark_weekly_return
        from path join wk on path.date = wk.date""",
        "panel_dates",
        rounded="strategy_cumulative benchmark_cumulative strategy_weekly_return benchmark_weekly_return",
        extra=QUARTER_PARTS,
    ),
)
def variant_quarter_weekly(spark, folder):
    return rounded(variants.script_quarter(scored_panel(spark, folder))["weekly"])


@register(
    "variant_quarter_summary",
    sql(
        """select (select cut_date from cut) as cutoff_date, (select concat('Q', quarter(min(date)), ' ', year(min(date))) from fwd) as quarter_label,
        count(*) as forward_weeks, round(arg_max(path.s, path.date) - 1, 4) as strategy_quarter_return, round(arg_max(path.b, path.date) - 1, 4) as benchmark_quarter_return,
        round((arg_max(path.s, path.date) - arg_max(path.b, path.date)) * 10000)::int as outperformance_bps,
        round(round((arg_max(path.s, path.date) - arg_max(path.b, path.date)) * 1e9) / 4) as dollar_impact_quarter,
        round((arg_max(path.s, path.date) - arg_max(path.b, path.date)) * 1e9) as dollar_impact_annualised,
        (select count(*) from uni where high) as n_excluded, (select count(*) from uni where not high) as n_held,
        (select round(count(*) filter (f.p1 / f.p0 - 1 < 0) / count(*), 4) from exc e left join
        (select p.ticker, arg_min(p.adj_close, p.date) as p0, arg_max(p.adj_close, p.date) as p1 from scored_panel p join fwd on p.date = fwd.date group by 1) f
        on e.ticker = f.ticker) as pct_excluded_correct from path""",
        "panel_dates",
        rounded=_DOLLARS,
        extra=QUARTER_PARTS,
    ),
)
def variant_quarter_summary(spark, folder):
    return rounded(variants.script_quarter(scored_panel(spark, folder))["summary"], _DOLLARS)


@register(
    "variant_metrics",
    sql(
        """select t.model, t.split, round(a.roc_auc, 4) + 0.0 as roc_auc, round(t.precision_at_top_bucket, 4) + 0.0 as precision_at_top_bucket,
        round(t.crash_capture_at_top_bucket, 4) + 0.0 as crash_capture_at_top_bucket from tops t join auc a on t.model = a.model and t.split = a.split""",
        "scored",
        extra=_MODEL_SQL,
    ),
)
def variant_metrics(spark, folder):
    report = variants.script_metrics(evaluation.evaluate(two_models(spark, folder)))
    return rounded(report.select("model", "split", *evaluation.METRICS))


@register("variant_holdout_search")
def variant_holdout_search(spark, folder):
    return variants.holdout_search(panel(spark, folder))

"""Independent SQL for the registered queries, in DuckDB's dialect.

Each text is built from shared WITH parts over the star-schema views.
"""

from __future__ import annotations

from tailspark.config import FEATURES, feature_group

FRIDAY = "{d} + CAST((5 - dayofweek({d}) + 7) % 7 AS INTEGER)"


def friday(d: str) -> str:
    return FRIDAY.format(d=d)


PARTS: dict[str, str] = {
    "prices": """
select concat('S', cast(l_suppkey as varchar)) as ticker, cast(l_shipdate as date) as date,
       sum(l_extendedprice) / sum(l_quantity) as adj_close, sum(l_quantity) as volume
from lineitem group by l_suppkey, cast(l_shipdate as date)""",
    "benchmark_prices": """
select cast(l_shipdate as date) as date, sum(l_extendedprice) / sum(l_quantity) as benchmark_close
from lineitem group by cast(l_shipdate as date)""",
    "controversies": """
select concat('S', cast(l.l_suppkey as varchar)) as ticker, last_day(cast(l.l_shipdate as date)) as date,
       min(r.r_name) as sector,
       10 * avg(case when l.l_returnflag = 'R' then 1::double else 0::double end) as controversy_score
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
     join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
group by l.l_suppkey, last_day(cast(l.l_shipdate as date))""",
    "fundamentals": """
select *, period_end + 45 as available_date from (
  select concat('S', cast(l.l_suppkey as varchar)) as ticker,
         last_day(cast(date_trunc('quarter', o.o_orderdate) as date) + interval 2 month) as period_end,
         sum(o.o_totalprice) as market_cap, cast(1000 * count(*) as double) as shares_outstanding,
         avg(o.o_totalprice) / nullif(max(s.s_acctbal), 0) as market_to_book,
         avg(l.l_discount) as leverage, avg(l.l_tax) as roa
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey
       join supplier s on l.l_suppkey = s.s_suppkey
  group by l.l_suppkey, date_trunc('quarter', o.o_orderdate))""",
    "news_text": """
select concat('S', cast(doc_id % (select count(*) from supplier) as varchar)) as ticker,
       date '1995-01-06' + cast((doc_id * 37) % 2300 as int) as date, source, text, doc_id as text_id
from documents""",
    "weekly": f"""
select ticker, week as date, adj_close, weekly_volume,
       adj_close / nullif(lag(adj_close) over (partition by ticker order by week), 0) - 1 as weekly_return
from (select ticker, {friday('date')} as week, arg_max(adj_close, date) as adj_close,
             sum(volume) as weekly_volume
      from prices group by ticker, {friday('date')})""",
    "bench_weekly": f"""
select week as date, benchmark_close,
       benchmark_close / lag(benchmark_close) over (order by week) - 1 as benchmark_return
from (select {friday('date')} as week, arg_max(benchmark_close, date) as benchmark_close
      from benchmark_prices group by {friday('date')})""",
    "known": """
select w.*, b.benchmark_return, w.weekly_return - b.benchmark_return as firm_specific_return,
       f.period_end, f.available_date, f.market_cap, f.shares_outstanding, f.market_to_book,
       f.leverage, f.roa, c.sector as raw_sector, c.controversy_score,
       w.weekly_volume / nullif(f.shares_outstanding, 0) as turnover
from weekly w
left join bench_weekly b on w.date = b.date
asof left join fundamentals f on w.ticker = f.ticker and f.available_date <= w.date
asof left join controversies c on w.ticker = c.ticker and c.date <= w.date""",
    "windows": """
select *,
       count(turnover) over w26 as t_n, avg(turnover) over w26 as t_mean, stddev_samp(turnover) over w26 as t_std,
       count(weekly_return) over w26 as r_n, product(1 + weekly_return) over w26 as r_growth,
       stddev_samp(weekly_return) over w26 as r_std,
       count(case when benchmark_return is not null then weekly_return end) over w26 as b_n,
       covar_samp(weekly_return, benchmark_return) over w26 as b_cov,
       var_samp(case when weekly_return is not null then benchmark_return end) over w26 as b_var,
       count(case when benchmark_return < 0 then weekly_return end) over w26 as d_n,
       covar_samp(weekly_return, case when benchmark_return < 0 then benchmark_return end) over w26 as d_cov,
       var_samp(case when weekly_return is not null and benchmark_return < 0 then benchmark_return end) over w26 as d_var,
       count(firm_specific_return) over w26 as f_n,
       sum(firm_specific_return ** 2) over w26 as f_s2, sum(firm_specific_return ** 3) over w26 as f_s3,
       avg(firm_specific_return) over w26 as f_mean,
       list(firm_specific_return) filter (firm_specific_return is not null) over w26 as f_list,
       count(firm_specific_return) over a13 as a_n,
       sum(firm_specific_return ** 2) over a13 as a_s2, sum(firm_specific_return ** 3) over a13 as a_s3,
       avg(firm_specific_return) over a13 as a_mean,
       list(firm_specific_return) filter (firm_specific_return is not null) over a13 as a_list,
       controversy_score - lag(controversy_score, 4) over t as controversy_change_4w,
       controversy_score - lag(controversy_score, 13) over t as controversy_change_13w,
       controversy_score - lag(controversy_score, 26) over t as controversy_change_26w,
       avg(controversy_score) over w4 as controversy_rolling_mean_4w,
       avg(controversy_score) over w13 as controversy_rolling_mean_13w,
       avg(controversy_score) over w26 as controversy_rolling_mean_26w,
       stddev_samp(controversy_score) over w4 as controversy_rolling_std_4w,
       stddev_samp(controversy_score) over w13 as controversy_rolling_std_13w,
       stddev_samp(controversy_score) over w26 as controversy_rolling_std_26w
from known
window t as (partition by ticker order by date),
       w4 as (partition by ticker order by date rows between 3 preceding and current row),
       w13 as (partition by ticker order by date rows between 12 preceding and current row),
       w26 as (partition by ticker order by date rows between 25 preceding and current row),
       a13 as (partition by ticker order by date rows between 1 following and 13 following)""",
    "split_lists": """
select *,
       list_filter(f_list, lambda x: x < f_mean) as f_dn, list_filter(f_list, lambda x: x >= f_mean) as f_up,
       list_filter(a_list, lambda x: x < a_mean) as a_dn, list_filter(a_list, lambda x: x >= a_mean) as a_up
from windows""",
    "sums": """
select *,
       list_sum(list_transform(f_dn, lambda x: x * x)) as f_dn2, list_sum(list_transform(f_up, lambda x: x * x)) as f_up2,
       list_sum(list_transform(a_dn, lambda x: x * x)) as a_dn2, list_sum(list_transform(a_up, lambda x: x * x)) as a_up2
from split_lists""",
    "dataset0": """
select ticker, date, adj_close, weekly_volume, weekly_return, benchmark_return, firm_specific_return,
       period_end, available_date, market_cap, shares_outstanding, market_to_book, leverage, roa, turnover,
       case when t_n >= 8 then turnover - t_mean end as detrended_turnover,
       case when t_n >= 8 and t_std <> 0 then (turnover - t_mean) / t_std end as turnover_zscore,
       case when r_n >= 8 then r_growth - 1 end as trailing_return,
       case when r_n >= 8 then r_std * sqrt(52) end as realized_volatility,
       case when b_n >= 8 and b_var > 0 then b_cov / b_var end as beta,
       case when b_n >= 8 and d_n >= 3 and d_var > 0 then d_cov / d_var end as downside_beta,
       case when b_n >= 8 and d_n >= 3 and d_var > 0 and b_var > 0 then d_cov / d_var - b_cov / b_var end as relative_downside_beta,
       coalesce(raw_sector, 'Unknown') as sector, controversy_score,
       controversy_change_4w, controversy_change_13w, controversy_change_26w,
       controversy_rolling_mean_4w, controversy_rolling_mean_13w, controversy_rolling_mean_26w,
       controversy_rolling_std_4w, controversy_rolling_std_13w, controversy_rolling_std_26w,
       coalesce(cast(controversy_score > controversy_rolling_mean_26w + 2 * coalesce(controversy_rolling_std_26w, 0) as int), 0) as controversy_spike_flag,
       case when f_n >= 8 and f_s2 > 0 then -(f_n * (f_n - 1) ** 1.5 * f_s3) / ((f_n - 1) * (f_n - 2) * f_s2 ** 1.5) end as lagged_ncskew,
       case when f_n >= 8 and len(f_dn) > 1 and len(f_up) > 1 and f_dn2 > 0 and f_up2 > 0
            then ln(((len(f_up) - 1) * f_dn2) / ((len(f_dn) - 1) * f_up2)) end as lagged_duvol,
       case when a_n >= 3 and a_s2 > 0 then -(a_n * (a_n - 1) ** 1.5 * a_s3) / ((a_n - 1) * (a_n - 2) * a_s2 ** 1.5) end as future_ncskew,
       case when a_n >= 4 and len(a_dn) > 1 and len(a_up) > 1 and a_dn2 > 0 and a_up2 > 0
            then ln(((len(a_up) - 1) * a_dn2) / ((len(a_dn) - 1) * a_up2)) end as future_duvol
from sums""",
    "dataset": """
select *,
       case when controversy_score is not null then
         (rank() over (partition by date, sector order by controversy_score nulls last)
          + (count(*) over (partition by date, sector, controversy_score) - 1) / 2.0)
         / count(controversy_score) over (partition by date, sector) end as controversy_sector_percentile,
       case when future_ncskew is not null then
         cast(future_ncskew >= quantile_cont(future_ncskew, 0.8) over (partition by date) as int) end as high_crash_risk
from dataset0""",
    "labelled": "select * from dataset where high_crash_risk is not null",
    "dated": """
select date, row_number() over (order by date) - 1 as place, count(*) over () as n
from (select distinct date from labelled)""",
    "splits": """
select date, case when place < greatest(1, floor(n * 0.6::double)) then 'train'
                  when place < least(greatest(greatest(1, floor(n * 0.6::double)) + 1, floor(n * 0.8::double)), n - 1) then 'validation'
                  else 'test' end as split
from dated""",
    "scored_panel": """
select *, round(1 / (1 + exp(-(0.5 * coalesce(lagged_ncskew, 0) + 0.1 * coalesce(controversy_score, 0)))), 9) as crash_probability,
       round(1 / (1 + exp(-(0.5 * coalesce(lagged_ncskew, 0)))), 9) as base_probability
from dataset""",
    "scored": """
select d.ticker, d.date, d.high_crash_risk, d.crash_probability, d.base_probability, s.split
from scored_panel d join splits s on d.date = s.date where d.high_crash_risk is not null""",
    "latest": """
select ticker, cast(date as varchar) as as_of_date, crash_probability,
       case when row_number() over (order by crash_probability desc, ticker) <= greatest(1, ceil(count(*) over () * 0.2::double)) then 'High'
            when row_number() over (order by crash_probability desc, ticker)
                 <= greatest(1, ceil(count(*) over () * 0.2::double)) + ceil(count(*) over () * 0.4::double) then 'Medium'
            else 'Low' end as risk_bucket
from scored_panel where date = (select max(date) from scored_panel)""",
    "panel_dates": """
select date, row_number() over (order by date) - 1 as place, count(*) over () as n,
       lead(date) over (order by date) as return_date
from (select distinct date from scored_panel)""",
    "ahead": """
select * from (
  select ticker, date, crash_probability,
         lead(weekly_return) over (partition by ticker order by date) as next_week_return from scored_panel)
where next_week_return is not null
  and date > (select date from panel_dates where place = floor(n * 0.6::double))""",
    "buckets": """
select *, row_number() over (partition by date order by crash_probability desc, ticker)
          <= greatest(1, ceil(count(*) over (partition by date) * 0.2::double)) as high
from ahead""",
    "overlay": """
select b.date, p.return_date,
       coalesce(avg(case when not high then next_week_return end), avg(next_week_return)) as strategy,
       avg(next_week_return) as benchmark, count(*) filter (not high) as n_holdings,
       count(*) filter (high) as n_excluded,
       string_agg(case when high then ticker end, ';' order by ticker) as excluded_tickers
from buckets b join panel_dates p on b.date = p.date group by b.date, p.return_date""",
    "tokens": """
select *, regexp_extract_all(lower(text), '[a-z]+') as toks from news_text""",
    "text_scored": """
select ticker, date, text_id, neg, pos, kw, n,
       case when n > 0 then (pos - neg) / n::double else 0 end as sentiment,
       case when n > 0 then greatest(neg - pos, 0) / n::double else 0 end as intensity,
       case when n > 0 then kw / n::double else 0 end as density,
       case when n > 0 then 1.0::double else 0 end as pressure
from (select *, len(list_filter(toks, lambda t: t in ('er', 'nd', 'ha'))) as neg,
             len(list_filter(toks, lambda t: t in ('th', 're', 'he'))) as pos,
             len(list_filter(toks, lambda t: t in ('es', 'en', 'ing'))) as kw, len(toks) as n from tokens)""",
    "text_weekly0": f"""
select ticker, {friday('date')} as date, count(*) as article_count, avg(sentiment) as text_sentiment_score,
       sum(neg)::bigint as negative_word_count, sum(pos)::bigint as positive_word_count,
       sum(kw)::bigint as controversy_keyword_count, sum(n)::bigint as total_token_count,
       avg(intensity) as negative_sentiment_intensity, avg(density) as controversy_keyword_density,
       avg(pressure) as news_pressure_component
from text_scored group by ticker, {friday('date')}""",
    "text_weekly": """
select 'ok' as status, 'documents' as source_file, *,
       round(100 * (0.5 * least(1, negative_sentiment_intensity * 8) + 0.35 * least(1, controversy_keyword_density * 10)
                    + 0.15 * least(1, ln(1 + article_count) / ln(6))), 2) as negative_esg_controversy_score_0_100,
       avg(text_sentiment_score) over (partition by ticker order by date rows between 12 preceding and current row) as rolling_sentiment_13w
from text_weekly0""",
}

NEEDS = {
    "weekly": ["prices"],
    "bench_weekly": ["benchmark_prices"],
    "known": ["weekly", "bench_weekly", "fundamentals", "controversies"],
    "windows": ["known"],
    "split_lists": ["windows"],
    "sums": ["split_lists"],
    "dataset0": ["sums"],
    "dataset": ["dataset0"],
    "labelled": ["dataset"],
    "dated": ["labelled"],
    "splits": ["dated"],
    "scored_panel": ["dataset"],
    "scored": ["scored_panel", "splits"],
    "latest": ["scored_panel"],
    "panel_dates": ["scored_panel"],
    "ahead": ["scored_panel", "panel_dates"],
    "buckets": ["ahead"],
    "overlay": ["buckets", "panel_dates"],
    "tokens": ["news_text"],
    "text_scored": ["tokens"],
    "text_weekly0": ["text_scored"],
    "text_weekly": ["text_weekly0"],
}


def _ordered(names: list[str]) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS.get(name, []):
            visit(need)
        if name not in seen:
            seen.append(name)

    for name in names:
        visit(name)
    return seen


def steps(column: str, places: int = 6) -> str:
    """Round with the midpoint moved off one half, as the queries do."""
    return f"floor({column} * 1e{places} + 0.5137) / 1e{places}"


def ten_digits(column: str) -> str:
    """Six places, or ten significant digits where that is less, as `rounded_to_digits` does."""
    places = f"least(6, 9 - floor(log10(abs({column}))))"
    up, down = f"pow(1e1, greatest({places}, 0))", f"pow(1e1, greatest(-{places}, 0))"
    return f"case when {column} = 0 then {column} else floor({column} * {up} / {down} + 0.5137) / {up} * {down} end"


def sql(
    select: str, *parts: str, rounded: str | dict[str, int] = "", extra: dict[str, str] | None = None, digits: str = ""
) -> str:
    """A statement over the named parts; `rounded` columns get 6 places, or the given number, `digits` columns ten digits."""
    views = [f"{n} as materialized ({PARTS[n]})" for n in _ordered(list(parts))]
    views += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    head = f"with {', '.join(views)} " if views else ""
    places = {c: 6 for c in rounded.split()} if isinstance(rounded, str) else rounded
    if places:
        changes = ", ".join(
            [f"{steps(c, d)} as {c}" for c, d in places.items()] + [f"{ten_digits(c)} as {c}" for c in digits.split()]
        )
        return f"{head}select * replace ({changes}) from ({select}) as final_rows"
    return head + select


PANEL_DOUBLES = {
    **{
        c: 6
        for c in (
            "adj_close weekly_return benchmark_return firm_specific_return market_to_book leverage roa "
            "turnover detrended_turnover turnover_zscore trailing_return realized_volatility beta "
            "downside_beta relative_downside_beta controversy_score controversy_change_4w "
            "controversy_change_13w controversy_change_26w controversy_rolling_mean_4w "
            "controversy_rolling_mean_13w controversy_rolling_mean_26w controversy_rolling_std_4w "
            "controversy_rolling_std_13w controversy_rolling_std_26w lagged_ncskew lagged_duvol "
            "controversy_sector_percentile"
        ).split()
    },
    "market_cap": 2,
}


def doubles(*columns: str) -> dict[str, int]:
    return {c: PANEL_DOUBLES.get(c, 6) for c in columns}

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tailspark.plans import downside, portfolio, reports, text, variants
from tailspark.functions import text as words


def friday(i):
    return dt.date(2020, 1, 3) + dt.timedelta(weeks=i)


def test_overlay_holds_all_but_the_riskiest(spark):
    next_returns = {"A": -0.10, "B": 0.02, "C": 0.03, "D": 0.04, "E": 0.05}
    rows = [
        (t, friday(w), (r if w == 2 else 0.01), 0.9 if t == "A" else 0.1)
        for t, r in next_returns.items()
        for w in range(3)
    ]
    panel = spark.createDataFrame(rows, "ticker string, date date, weekly_return double, crash_probability double")
    for listed in (False, True):
        got = portfolio.forward_overlay(panel, start_share=0.0, list_excluded=listed).collect()
        assert len(got) == 1
        row = got[0]
        assert (row.date, row.return_date, row.n_holdings, row.n_excluded) == (friday(1), friday(2), 4, 1)
        assert math.isclose(row.benchmark, 0.008) and math.isclose(row.strategy, 0.035)
    assert got[0].excluded_tickers == "A"
    assert [r.ticker for r in portfolio.excluded_names(panel, 0.0).collect()] == ["A"]


def perf(spark, returns, benchmark=None):
    rows = [(friday(i), float(r), float(b), 8, 2) for i, (r, b) in enumerate(zip(returns, returns if benchmark is None else benchmark))]
    return spark.createDataFrame(rows, "date date, strategy double, benchmark double, n_holdings long, n_excluded long")


def test_business_figures(spark):
    r = np.array([-0.05, 0.02, -0.03, 0.04, 0.01, -0.02, 0.03, 0.02, -0.01, 0.02, 0.01, -0.04])
    row = portfolio.business_summary(perf(spark, r, r * 0.5)).first()
    excess = r - 0.04 / 52
    wealth = np.cumprod(1 + r)
    assert row.strategy_annual_return == round(np.prod(1 + r) ** (52 / 12) - 1, 4)
    assert row.strategy_sharpe == round(excess.mean() / excess.std(ddof=1) * 52**0.5, 3)
    down = excess[excess < 0]
    assert row.strategy_sortino == round(excess.mean() / down.std(ddof=1) * 52**0.5, 3)
    # the first week's loss lies before the first peak
    assert row.max_drawdown_strategy == round(min(wealth / np.maximum.accumulate(wealth) - 1), 4)
    assert row.var_95_weekly == 0.05 and row.cvar_95_weekly == 0.05
    assert row.high_risk_excluded_pct == 0.2 and row.evaluation_weeks == 12
    few = portfolio.business_summary(perf(spark, r[:9])).first()
    assert few.var_95_weekly is None and few.strategy_annual_return is not None
    assert portfolio.business_summary(perf(spark, r[:7])).isEmpty()


def test_quarter_backtest(spark):
    rows = []
    for t, p, drift in (("A", 0.9, -0.01), ("B", 0.2, 0.02), ("C", 0.1, 0.01), ("D", 0.05, 0.0), ("E", 0.01, 0.01)):
        price = 100.0
        for w in range(8):
            price *= 1 + drift
            rows.append((t, friday(w), price, drift, p))
    panel = spark.createDataFrame(rows, "ticker string, date date, adj_close double, weekly_return double, crash_probability double")
    got = portfolio.quarter_backtest(panel, forward_weeks=4)
    s = got["summary"].first()
    assert s.cutoff_date == friday(3) and s.forward_weeks == 4 and (s.n_excluded, s.n_held) == (1, 4)
    assert s.strategy_quarter_return == round(1.01**4 - 1, 4) and s.pct_excluded_correct == 1.0
    assert s.quarter_label == "Q1 2020"
    out = got["excluded"].first()
    assert (out.ticker, out.outcome, out.quarter_return) == ("A", "Avoided loss", round(0.99**4 - 1, 4))
    assert got["weekly"].count() == 4
    asked = portfolio.quarter_backtest(panel, cutoff=(friday(2) + dt.timedelta(days=3)).isoformat(), forward_weeks=4)
    assert asked["summary"].first().cutoff_date == friday(2)


def test_scores_of_texts(spark):
    df = spark.createDataFrame([("Fraud, FRAUD probe! award x9",), ("123",), ("",)], "text string")
    got = [r.asDict() for r in text.scored_texts(df).collect()]
    first = next(r for r in got if r["text"].startswith("Fraud"))
    assert (first["negative_word_count"], first["positive_word_count"], first["controversy_keyword_count"]) == (3, 1, 2)
    assert first["token_count"] == 5 and math.isclose(first["text_sentiment_score"], -0.4)
    assert all(r["text_sentiment_score"] == 0 and r["news_pressure_component"] == 0 for r in got if r is not first)


def test_phrase_words_skip_digits_and_accents(spark):
    df = spark.createDataFrame([("ab x9 été c3 naïve Fine-day",)], "text string")
    assert df.select(words.phrase_tokens(F.col("text")).alias("w")).first().w == ["ab", "fine", "day"]


def test_tickers_are_stop_words(spark):
    df = spark.createDataFrame(
        [("1", "ABC", "abc rises and def falls"), ("2", "DEF", "the def abc rises again"), ("3", "X1", "abc")],
        "text_id string, ticker string, text string",
    )
    got = {r.text_id: r.words for r in text.kept_words(df, ["the", "and"]).collect()}
    assert got == {"1": ["rises", "falls"], "2": ["rises", "again"], "3": []}


def test_topics(spark):
    rows = [("A", friday(0), "oil spill river oil"), ("A", friday(1), "oil river"), ("B", friday(0), "chip demand chip")]
    df = spark.createDataFrame(rows, "ticker string, date date, text string")
    got = text.topics(df, n_topics=2, stop_words=[])
    shares = got["ticker_topics"].collect()
    assert {r.ticker for r in shares} == {"A", "B"}
    assert all(math.isclose(r.topic_1 + r.topic_2, 1.0, abs_tol=1e-6) for r in shares)
    assert all(r.topic_probability == max(r.topic_1, r.topic_2) for r in shares)
    assert {r.topic for r in got["topic_words"].collect()} == {"topic_1", "topic_2"}
    empty = text.topics(df, stop_words=["oil", "spill", "river", "chip", "demand"])
    assert empty["topic_words"].first().status == "empty_vocabulary"


def test_scenarios_widen_only_downwards(spark):
    panel = spark.createDataFrame(
        [("A", friday(0), 90.0, 0.2), ("A", friday(1), 100.0, 0.3), ("B", friday(1), 100.0, 0.3), ("C", friday(1), 10.0, None)],
        "ticker string, date date, adj_close double, realized_volatility double",
    )
    scores = spark.createDataFrame(
        [("A", "2020-01-10", 0.1, "Low"), ("B", "2020-01-10", 0.9, "High"), ("C", "2020-01-10", None, "Low")],
        "ticker string, as_of_date string, crash_probability double, risk_bucket string",
    )
    got = {r.ticker: r for r in reports.price_scenarios(panel, scores).collect()}
    assert got["A"].latest_price == 100.0 and got["B"].price_p05 < got["A"].price_p05
    assert got["A"].price_p95 == got["B"].price_p95 and got["C"].price_p05 == got["C"].price_p95 == 10.0
    assert reports.price_history(panel, 1).where("ticker = 'A'").first().adj_close == 100.0


def test_importance_percents_add_up(spark):
    df = spark.createDataFrame([(f"f{i:02d}", 1.0) for i in range(17)], "feature string, importance double")
    got = reports.importance_percents(df).collect()
    assert len(got) == 15 and sum(r.percent for r in got) == 100 and {r.percent for r in got} == {6, 7}


def test_correlations_skip_missing_pairs(spark):
    from tailspark import Settings

    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0), (2.0, None, 5.0), (3.0, 7.0, 5.0), (None, 1.0, 5.0), (5.0, 6.0, 5.0)], "a double, b double, c double"
    )
    got = {r.feature: r.asDict() for r in reports.correlation_matrix(df, Settings(features=("a", "b", "c", "d"))).collect()}
    want = df.toPandas()[["a", "b"]].corr().loc["a", "b"]
    assert math.isclose(got["a"]["b"], want) and math.isclose(got["b"]["a"], want) and math.isclose(got["a"]["a"], 1.0)
    assert got["c"]["c"] is None and got["a"]["c"] is None and got["d"]["a"] is None


def test_downside_signal_ranks_losers_highest(spark):
    rows = [(t, dt.date(2020, m, 10), p) for t, ps in (("A", [10, 9, 8, 7, 6]), ("B", [10, 11, 12, 13, 14])) for m, p in enumerate(map(float, ps), 1)]
    df = spark.createDataFrame(rows, "ticker string, date date, adj_close double")
    got = {(r.ticker, r.date.month): r.future_downside_signal for r in downside.forward_downside_signal(df).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 1.0, ("B", 1): 0.5, ("B", 2): 0.5}


def test_empty_weeks_variant(spark):
    df = spark.createDataFrame(
        [("A", friday(0), 10.0, 1.0), ("A", friday(2), 12.0, 3.0)], "ticker string, date date, adj_close double, volume double"
    )
    got = [tuple(r)[2:] for r in variants.weekly_with_empty_weeks(df).orderBy("date").collect()]
    assert got[0] == (10.0, 1.0, None) and got[1] == (None, 0.0, 0.0) and math.isclose(got[2][2], 0.2)


def _brute_bigrams(rows, stop, vocabulary, top, good, bad):
    """Mean of length-one pair weights of each bucket, text by text."""
    tickers = {t.lower() for t, _ in rows if t and re.fullmatch("[a-z]{2,}", t.lower())}
    found = {}
    for bucket, sign in (("bearish", -1), ("bullish", 1)):
        texts = []
        for _, body in rows:
            tokens = re.findall(r"\w+", (body or "").lower())
            letters = re.findall("[a-z]+", (body or "").lower())
            score = sum(w in good for w in letters) - sum(w in bad for w in letters)
            if score * sign > 0:
                kept = [w for w in tokens if re.fullmatch("[a-z][a-z]+", w) and w not in stop and w not in tickers]
                texts.append(Counter(f"{x} {y}" for x, y in zip(kept, kept[1:])))
        totals = sum(texts, Counter())
        kept = sorted(totals, key=lambda p: (-totals[p], p))[:vocabulary]
        idf = {p: np.log((1 + len(texts)) / (1 + sum(p in t for t in texts))) + 1 for p in kept}
        means = dict.fromkeys(kept, 0.0)
        for t in texts:
            weights = {p: t[p] * idf[p] for p in kept if p in t}
            length = np.sqrt(sum(w * w for w in weights.values()))
            for p, w in weights.items():
                means[p] += w / length / len(texts)
        for p in sorted(means, key=lambda p: (-round(means[p], 12), p))[:top]:
            found[bucket, p] = means[p]
    return found


@pytest.mark.parametrize("in_row", [10_000, 0])
def test_bigrams_equal_brute_force_with_the_default_stop_words(spark, monkeypatch, in_row):
    monkeypatch.setattr(text, "TICKER_WORDS", in_row)
    rng = random.Random(5)
    pool = "the and rise gain fraud loss acme bolt market plan growth of very plant report x1 lawsuit".split()
    rows = [(rng.choice(["ACME", "BOLT", "A1", None]), " ".join(rng.choices(pool, k=rng.randrange(0, 40)))) for _ in range(60)]
    rows += [("ACME", None), ("ACME", ""), ("ACME", "gain " * 500), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "ticker string, text string")
    lexicon = dict(positive=["rise", "gain", "growth"], negative=["fraud", "loss", "lawsuit"])
    got = {
        (r.sentiment_bucket, r.bigram): r.tfidf_weight
        for r in text.bigram_terms(df, vocabulary=25, top=7, **lexicon).collect()
    }
    stop = set(text.default_stop_words())
    assert {"the", "and", "of", "very"} <= stop
    want = _brute_bigrams(rows, stop, 25, 7, set(lexicon["positive"]), set(lexicon["negative"]))
    assert got.keys() == want.keys() and len(got) == 14
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert text.bigram_terms(df.limit(0), **lexicon).collect() == []


def test_topic_certificate(spark, monkeypatch):
    rng = random.Random(2)
    themes = ["oil river spill rig barrel".split(), "chip wafer demand fab node".split()]
    rows = [(t, friday(i), " ".join(rng.choices(themes[(i + j) % 2], k=rng.randrange(1, 40)))) for j, t in enumerate("AB") for i in range(20)]
    rows += [("C", friday(0), None), ("C", friday(1), "oil"), ("D", friday(3), "")]
    df = spark.createDataFrame(rows, "ticker string, date date, text string")
    fitted = text.fit_topics(df, n_topics=2, stop_words=[])
    got = {r.ticker: r for r in text.topic_certificate(fitted).collect()}
    assert {t: (r.article_count, r.date_start, r.date_end) for t, r in got.items()} == {
        "A": (20, "2020-01-03", "2020-05-15"), "B": (20, "2020-01-03", "2020-05-15"), "C": (2, "2020-01-03", "2020-01-10"),
        "D": (1, "2020-01-24", "2020-01-24"),
    }
    assert all(r.step < 1e-3 for r in got.values()) and got["D"].shares_sum is None
    assert all(abs(r.shares_sum - 1) < 1e-9 for r in got.values() if r.ticker != "D")
    # the check tells another update rule apart
    monkeypatch.setattr(text, "_digamma", np.log)
    assert max(r.step for r in text.topic_certificate(fitted).collect()) > 1e-2
    assert text.fit_topics(df.limit(0)) is None


def test_shares_are_carried_on_until_they_settle(spark):
    # themes that share most words settle slowly: Spark's shares move on by close to the certificate's bound
    rng = random.Random(5)
    common = "oil river chip wafer node fab rig".split()
    rows = [(f"T{i}", friday(i % 30), " ".join(rng.choices(common, k=60) + [["spill", "demand"][i % 2]] * (i % 3))) for i in range(120)]
    fitted = text.fit_topics(spark.createDataFrame(rows, "ticker string, date date, text string"), n_topics=4, stop_words=[])
    steps = [r.step for r in text.topic_certificate(fitted).collect()]
    assert len(steps) == 120 and max(steps) < 1.5 * text.SETTLED


def test_texts_without_words_have_the_shares_of_the_prior(spark):
    rows = [("A", friday(i), w) for i, w in enumerate(("oil river spill", "chip wafer", "oil chip chip"))]
    rows += [("C", friday(0), None), ("C", friday(1), "oil"), ("D", friday(3), ""), ("E", friday(3), "12 34")]
    df = spark.createDataFrame(rows, "ticker string, date date, text string")
    fitted = text.fit_topics(df, n_topics=2, stop_words=[])
    got = {r.ticker: r for r in text.topic_tables(fitted)["ticker_topics"].collect()}
    assert all(abs(r.topic_1 + r.topic_2 - 1) < 1e-9 for r in got.values())
    prior = fitted.model.estimatedDocConcentration().toArray()
    assert np.allclose([[got[t].topic_1, got[t].topic_2] for t in "DE"], prior / prior.sum())
    # the certificate's update leaves the prior where it is
    assert {r.ticker: r.step for r in text.topic_certificate(fitted).collect()}["D"] < 1e-9


def test_digamma():
    # fixed values: minus Euler's constant at one; each step up adds 1 / x
    assert abs(text._digamma(np.array(1.0)) + 0.5772156649015329) < 1e-8
    x = np.array([0.003, 0.2, 1.7, 5.5, 40.0, 1e6])
    assert np.allclose(text._digamma(x + 1) - text._digamma(x), 1 / x, rtol=1e-7, atol=1e-12)


def test_commonest_words_leave_no_tie_to_chance(spark):
    rows = spark.createDataFrame([(["d", "b", "c", "a"],), (["d", "c", "b"],), ([],)], "words array<string>").repartition(3)
    assert text.commonest_words(rows, 3) == ["b", "c", "d"]

"""News text: scores per week, coverage, typical word pairs and topics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailspark.config import TEXT_SIGNALS, Settings
from tailspark.functions import text as words
from tailspark.operators.calendar import split_cuts
from tailspark.operators.resample import week_end
from tailspark.staging import stage

TICKER_WORDS = 10_000  # tickers spelled like words that are looked up in the row
SLOTS = 64  # partial vectors that reach the driver


def scored_texts(texts: DataFrame, **lexicons: Sequence[str]) -> DataFrame:
    """Word counts and ratios per text."""
    counted = texts.withColumn("_tokens", words.tokens(F.col("text"))).withColumns(
        words.word_counts(F.col("_tokens"), **lexicons)
    )
    return counted.withColumns(words.word_scores()).drop("_tokens")


def weekly_text(texts: DataFrame, source_file: str = "", **lexicons: Sequence[str]) -> DataFrame:
    """One row per ticker and week with text, with its score, band and 13-row sentiment."""
    weekly = (
        scored_texts(texts, **lexicons)
        .groupBy("ticker", week_end("date").alias("week"))
        .agg(
            F.count("*").alias("article_count"),
            F.avg("text_sentiment_score").alias("text_sentiment_score"),
            F.sum("negative_word_count").alias("negative_word_count"),
            F.sum("positive_word_count").alias("positive_word_count"),
            F.sum("controversy_keyword_count").alias("controversy_keyword_count"),
            F.sum("token_count").alias("total_token_count"),
            F.avg("negative_sentiment_intensity").alias("negative_sentiment_intensity"),
            F.avg("controversy_keyword_density").alias("controversy_keyword_density"),
            F.avg("news_pressure_component").alias("news_pressure_component"),
        )
        .withColumnRenamed("week", "date")
    )
    score = words.negative_controversy_score(
        F.col("negative_sentiment_intensity"),
        F.col("controversy_keyword_density"),
        F.col("article_count"),
    )
    last_13 = Window.partitionBy("ticker").orderBy("date").rowsBetween(-12, Window.currentRow)
    return weekly.select(
        F.lit("ok").alias("status"),
        F.lit(source_file).alias("source_file"),
        "*",
        score.alias(TEXT_SIGNALS[0]),
        F.avg("text_sentiment_score").over(last_13).alias(TEXT_SIGNALS[1]),
        words.score_band(score).alias("score_band"),
    )


def ticker_text_summary(weekly: DataFrame) -> DataFrame:
    """The newest text week of each ticker; readers order by score, articles, ticker."""
    newest = weekly.groupBy("ticker").agg(
        F.max(F.struct("date", *[c for c in weekly.columns if c not in ("ticker", "date")])).alias("m")
    )
    return newest.select("ticker", "m.*").withColumnRenamed("date", "latest_text_date")


def ordered_ticker_summary(weekly: DataFrame) -> DataFrame:
    return ticker_text_summary(weekly).orderBy(
        F.col(TEXT_SIGNALS[0]).desc(), F.col("article_count").desc(), "ticker"
    )


def attach_text_signals(panel: DataFrame, weekly: DataFrame | None) -> DataFrame:
    """Left join of the weekly text signals; without text the columns are there as null."""
    signals = (*TEXT_SIGNALS, "text_article_count")
    bare = panel.drop(*signals)
    usable = weekly is not None and {"status", "ticker", "date", *TEXT_SIGNALS} <= set(weekly.columns)
    if not usable:
        return bare.withColumns({c: F.lit(None).cast("double") for c in signals})
    counted = "article_count" in weekly.columns
    articles = (F.col("article_count") if counted else F.lit(None).cast("long")).alias("text_article_count")
    rows = (
        weekly.where(F.col("status") == "ok")
        .select(
            F.upper(F.trim("ticker")).alias("ticker"),
            "date",
            F.struct(*TEXT_SIGNALS, articles).alias("m"),
        )
        .where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
        .groupBy("ticker", "date")
        .agg(F.max("m").alias("m"))
        .select(
            "ticker",
            "date",
            *[F.col(f"m.{c}").alias(c) for c in signals],
        )
    )
    return bare.join(rows, ["ticker", "date"], "left")


def text_coverage(weekly: DataFrame, dataset: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Articles, rows, tickers and matched model rows, over all and per split.

    `dataset` is a stored labelled panel. Text of a date outside the labelled dates counts
    only in the overall row.
    """
    settings = settings or Settings()
    labelled = dataset.where(F.col("high_crash_risk").isNotNull()).select("ticker", "date")
    cuts = split_cuts(labelled, settings.train_fraction, settings.validation_fraction, strict=False)
    model_dates = F.broadcast(labelled.select("date").distinct().withColumn("split", cuts.column()))
    text = stage(
        weekly.where(
            (F.col("status") == "ok") & F.col("ticker").isNotNull() & F.col("date").isNotNull()
        ).select("ticker", "date", "article_count", "source_file"),
        "text",
    )
    tagged = text.join(model_dates, "date", "left")
    pairs = labelled.groupBy("ticker", "date").agg(F.count("*").alias("rows"))
    matched = text.select("ticker", "date").distinct().join(pairs, ["ticker", "date"]).withColumn(
        "split", cuts.column()
    )

    names = ("overall", "train", "validation", "test")
    articles = F.coalesce(F.sum(F.coalesce("article_count", F.lit(0))), F.lit(0))
    by_split = (
        # overall is counted once per row, the split a second time where there is one
        tagged.select("ticker", "date", "article_count", "source_file", F.array_distinct(
            F.array(F.lit("overall"), F.coalesce("split", F.lit("overall")))
        ).alias("splits"))
        .withColumn("split", F.explode("splits"))
        .groupBy("split")
        .agg(
            articles.alias("article_count"),
            F.count("*").alias("weekly_text_rows"),
            F.count_distinct("ticker").alias("unique_tickers"),
            F.min("date").cast("string").alias("date_start"),
            F.max("date").cast("string").alias("date_end"),
        )
    )
    matches = (
        matched.withColumn("split", F.explode(F.array(F.lit("overall"), F.col("split"))))
        .groupBy("split")
        .agg(F.sum("rows").alias("matched_model_rows"))
    )
    frame = dataset.sparkSession.createDataFrame([(n,) for n in names], "split string")
    average = F.round(F.col("article_count") / F.nullif("unique_tickers", F.lit(0)), 4)
    return (
        frame.join(by_split, "split", "left")
        .join(matches, "split", "left")
        .select(
            "split",
            F.lit("ok").alias("status"),
            F.coalesce(text.agg(F.min("source_file")).scalar(), F.lit("")).alias("source_file"),
            F.coalesce("article_count", F.lit(0)).alias("article_count"),
            F.coalesce("weekly_text_rows", F.lit(0)).alias("weekly_text_rows"),
            F.coalesce("unique_tickers", F.lit(0)).alias("unique_tickers"),
            F.coalesce("date_start", F.lit("")).alias("date_start"),
            F.coalesce("date_end", F.lit("")).alias("date_end"),
            average.alias("avg_articles_per_ticker"),
            F.coalesce("matched_model_rows", F.lit(0)).alias("matched_model_rows"),
        )
    )


def empty_coverage(dataset: DataFrame, status: str = "no_text_file", source_file: str = "") -> DataFrame:
    return dataset.sparkSession.createDataFrame(
        [("overall", status, source_file, 0, 0, 0, "", "", None, 0)],
        "split string, status string, source_file string, article_count long, weekly_text_rows long, "
        "unique_tickers long, date_start string, date_end string, avg_articles_per_ticker double, "
        "matched_model_rows long",
    )


def default_stop_words() -> list[str]:
    """Spark's English list and the method's own words."""
    return sorted(
        {
            *StopWordsRemover.loadDefaultStopWords("english"),
            *words.STOP_WORDS,
            *words.PHRASE_STOP_WORDS,
        }
    )


def kept_words(texts: DataFrame, stop_words: Sequence[str]) -> DataFrame:
    """(columns of texts, words): phrase tokens without stop words and tickers.

    A ticker can only stop a word made of letters. Up to TICKER_WORDS of them are looked up in the row, so no
    text is shuffled; a longer list is a table of any size, and its words leave by an anti-join.
    """
    spelled = texts.select(F.lower("ticker").alias("word")).where(F.col("word").rlike("^[a-z]{2,}$")).distinct()
    stop = sorted(set(stop_words))
    found = [r.word for r in spelled.limit(TICKER_WORDS + 1).collect()]
    if len(found) <= TICKER_WORDS:
        stop = sorted({*stop, *found})
    else:
        texts = with_text_id(texts)
    # a missing text has no words
    tokens = words.phrase_tokens(F.coalesce("text", F.lit("")))
    plain = texts.withColumn("words", F.filter(tokens, lambda w: ~w.isin(stop)))
    return plain if len(found) <= TICKER_WORDS else _without_tickers(plain, spelled)


def with_text_id(texts: DataFrame) -> DataFrame:
    """Give each text an id. Random ids are written down at once, as readers must agree on them."""
    if "text_id" in texts.columns:
        return texts
    return stage(texts.withColumn("text_id", F.uuid()), "texts")


def _without_tickers(texts: DataFrame, spelled: DataFrame) -> DataFrame:
    exploded = texts.select("text_id", F.posexplode("words").alias("place", "word"))
    left = exploded.join(spelled, "word", "left_anti")
    # one text's words, which were one cell before
    again = left.groupBy("text_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda p: p["word"]).alias("words")
    )
    return texts.drop("words").join(again, "text_id", "left").withColumn(
        "words", F.coalesce("words", F.array().cast("array<string>"))
    )


def _pairs(tokens: Column) -> Column:
    return F.when(
        F.size(tokens) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - 1),
            lambda i: F.concat_ws(" ", F.element_at(tokens, i), F.element_at(tokens, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def bigram_terms(
    texts: DataFrame,
    stop_words: Sequence[str] | None = None,
    vocabulary: int = 2000,
    top: int = 10,
    **lexicons: Sequence[str],
) -> DataFrame:
    """(sentiment_bucket, bigram, tfidf_weight): the heaviest word pairs of good and bad news.

    Per bucket: the most frequent pairs form the vocabulary, each text's counts are weighted
    with ln((1+N)/(1+df))+1 and scaled to length one, and weights are averaged over all N
    texts. Pairs are counted, weighted and scaled inside a text's row as a sparse vector, so the only shuffle is that
    of the pairs' totals. The driver holds a number for each of the two times `vocabulary` pairs.
    """
    stop = default_stop_words() if stop_words is None else stop_words
    bucket = F.when(F.col("text_sentiment_score") > 0, "bullish").otherwise("bearish")
    scored = scored_texts(kept_words(texts, stop), **lexicons).where(F.col("text_sentiment_score") != 0)
    # narrow rows: the words of the text, written once, as their pairs are read twice
    rows = stage(scored.select(bucket.alias("sentiment_bucket"), "words"), "words").withColumn("pairs", _pairs(F.col("words")))
    totals = (
        rows.select("sentiment_bucket", F.explode("pairs").alias("bigram"))
        .groupBy("sentiment_bucket", "bigram")
        .agg(F.count("*").alias("total"))
    )
    totals = stage(totals, "pair-totals")
    kept = [
        (name, r.bigram)
        for name in ("bearish", "bullish")
        for r in totals.where(F.col("sentiment_bucket") == name).orderBy(F.col("total").desc(), "bigram").limit(vocabulary).collect()
    ]
    if not kept:
        return totals.select("sentiment_bucket", "bigram", F.lit(0.0).alias("tfidf_weight")).limit(0)
    # a pair of one bucket is another term than that of the other
    vocabulary_terms = [f"{name} {pair}" for name, pair in kept]
    counter = CountVectorizerModel.from_vocabulary(vocabulary_terms, inputCol="terms", outputCol="counts")
    terms = rows.select("sentiment_bucket", F.transform("pairs", lambda p: F.concat_ws(" ", "sentiment_bucket", p)).alias("terms"))
    counts = stage(counter.transform(terms).select("sentiment_bucket", "counts"), "pair-counts")
    texts_of = {r.sentiment_bucket: r.n for r in counts.groupBy("sentiment_bucket").agg(F.count("*").alias("n")).collect()}
    n_texts = np.array([texts_of[name] for name, _ in kept], float)
    holding = _vector_total(counts, "counts", "numNonZeros")
    idf = np.log((1 + n_texts) / (1 + holding)) + 1.0
    weighted = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weights").transform(counts)
    unit = Normalizer(p=2.0, inputCol="weights", outputCol="unit").transform(weighted)
    means = _vector_total(unit, "unit", "sum") / n_texts
    terms_found = [(name, pair, float(mean)) for (name, pair), mean in zip(kept, means)]
    frame = rows.sparkSession.createDataFrame(terms_found, "sentiment_bucket string, bigram string, tfidf_weight double")
    # at most two times `vocabulary` rows are ranked
    place = F.row_number().over(
        Window.partitionBy("sentiment_bucket").orderBy(F.round("tfidf_weight", 12).desc(), "bigram")
    )
    return frame.withColumn("_place", place).where(F.col("_place") <= top).drop("_place")


def _vector_total(df: DataFrame, column: str, metric: str) -> np.ndarray:
    """A summed metric of a vector column, merged in two levels: SLOTS vectors meet on the driver, not one for each task."""
    slots = df.select(F.pmod(F.spark_partition_id(), F.lit(SLOTS)).alias("slot"), column).groupBy("slot")
    parts = slots.agg(Summarizer.metrics(metric).summary(F.col(column)).getField(metric).alias("total")).collect()
    return np.sum([p.total.toArray() for p in parts], axis=0)


SETTLED = 1e-4  # a text's mean change of its topic counts; the certificate bears ten times as much
MOST_UPDATES = 5000


@dataclass(frozen=True)
class FittedTopics:
    rows: DataFrame  # ticker, date, features
    vocabulary: list[str]
    model: LDAModel
    k: int


def fit_topics(
    texts: DataFrame,
    n_topics: int = 5,
    vocabulary: int = 2000,
    seed: int = 42,
    iterations: int = 10,
    stop_words: Sequence[str] | None = None,
) -> FittedTopics | None:
    """LDA on the kept words of the texts; None where no text has any.

    The online optimiser takes every text in each iteration, which makes it batch variational Bayes.
    """
    stop = default_stop_words() if stop_words is None else stop_words
    prepared = stage(
        kept_words(texts, stop).select(F.upper(F.trim("ticker")).alias("ticker"), "date", "words"), "words"
    )
    n_texts = prepared.count()
    commonest = commonest_words(prepared, vocabulary)
    if not commonest:
        return None
    counter = CountVectorizerModel.from_vocabulary(commonest, inputCol="words", outputCol="features")
    # written once, as each iteration reads the counts anew
    rows = stage(counter.transform(prepared).select("ticker", "date", "features"), "word-counts")
    k = max(1, min(n_topics, n_texts))
    # Spark's LDA needs two topics; a single text is one topic by definition
    fitted_k = max(2, k)
    model = LDA(
        k=fitted_k,
        optimizer="online",
        subsamplingRate=1.0,
        maxIter=iterations,
        seed=seed,
        docConcentration=[1.0 / k] * fitted_k,
        topicConcentration=1.0 / k,
    ).fit(rows)
    return FittedTopics(rows, commonest, model, k)


def commonest_words(rows: DataFrame, most: int) -> list[str]:
    """The `most` words with the highest counts over all texts, highest first and ties by word."""
    totals = rows.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in totals.orderBy(F.col("n").desc(), "word").limit(most).collect()]


def topics(texts: DataFrame, source_file: str = "", top_words: int = 10, **fit) -> dict[str, DataFrame]:
    """LDA topics: `topic_words` (topic, rank, word, weight) and `ticker_topics` (mean shares); `fit` as for `fit_topics`.

    Numbers differ from other LDA programs; the shape and the rules (shares add up to one, dominant topic is
    the largest share) are the same, and `topic_certificate` checks each text's shares.
    """
    fitted = fit_topics(texts, **fit)
    return empty_topics(texts.sparkSession, "empty_vocabulary", source_file) if fitted is None else topic_tables(fitted, source_file, top_words)


def topic_tables(fitted: FittedTopics, source_file: str = "", top_words: int = 10) -> dict[str, DataFrame]:
    model, k = fitted.model, fitted.k
    vocabulary_words = F.array(*[F.lit(w) for w in fitted.vocabulary])
    label = F.concat(F.lit("topic_"), F.col("topic") + 1)
    topic_words = (
        model.describeTopics(top_words)
        .where(F.col("topic") < k)
        .select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "term"))
        .select(
            F.lit("ok").alias("status"),
            F.lit(source_file).alias("source_file"),
            label.alias("topic"),
            (F.col("place") + 1).alias("rank"),
            F.element_at(vocabulary_words, F.col("term.termIndices") + 1).alias("word"),
            F.col("term.termWeights").alias("weight"),
        )
    )
    shares = text_shares(fitted).select("ticker", "date", "shares")
    names = [f"topic_{i + 1}" for i in range(k)]
    means = shares.groupBy("ticker").agg(
        F.count("*").alias("article_count"),
        F.min("date").cast("string").alias("date_start"),
        F.max("date").cast("string").alias("date_end"),
        *[F.avg(F.col("shares")[i]).alias(name) for i, name in enumerate(names)],
    )
    every = F.array(*names)
    largest = F.array_max(every)
    ticker_topics = means.select(
        F.lit("ok").alias("status"),
        F.lit(source_file).alias("source_file"),
        "ticker",
        "article_count",
        "date_start",
        "date_end",
        F.concat(F.lit("topic_"), F.array_position(every, largest)).alias("dominant_topic"),
        largest.alias("topic_probability"),
        *names,
    )
    return {"topic_words": topic_words, "ticker_topics": ticker_topics}


def text_shares(fitted: FittedTopics) -> DataFrame:
    """(columns of the rows, shares): a text's topic shares; a text without words of the vocabulary has those of the prior.

    Spark gives such a text zeros, which would not add up to one and would pull its ticker's means down. It also stops
    a text's updates once they change its counts by less than 0.001, however slowly they still move; they are carried
    on here until they have settled.
    """
    prior = fitted.model.estimatedDocConcentration().toArray()
    nothing = [float(a) for a in prior / prior.sum()]
    update = _share_update(fitted)

    @F.pandas_udf("array<double>")
    def settled(indices: pd.Series, counts: pd.Series, shares: pd.Series) -> pd.Series:
        found = []
        for i, n, share in zip(indices, counts, shares):
            share = np.asarray(share, float)
            if not len(i) or not share.any():
                found.append(nothing)
                continue
            i, n = np.asarray(i, int), np.asarray(n, float)
            now = share * (prior.sum() + n.sum())
            for _ in range(MOST_UPDATES):
                before, now = now, update(i, n, now)
                if np.abs(now - before).mean() < SETTLED:
                    break
            found.append(now / now.sum())
        return pd.Series(found)

    rows = fitted.model.transform(fitted.rows).withColumns(
        {"_shares": vector_to_array("topicDistribution"), "_words": F.unwrap_udt("features")}
    )
    return rows.select(*fitted.rows.columns, settled("_words.indices", "_words.values", "_shares").alias("shares"))


def _digamma(x: np.ndarray) -> np.ndarray:
    """Shifted up to 6 or more, then the asymptotic series."""
    x, low = np.array(x, float), 0.0
    for _ in range(6):
        low = low + np.where(x < 6, 1 / x, 0.0)
        x = np.where(x < 6, x + 1, x)
    y = 1 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240))) - low


def _share_update(fitted: FittedTopics, digamma=_digamma):
    """The variational update of a text's topic counts from its words, with the topics held."""
    concentration = fitted.model.estimatedDocConcentration().toArray()
    weights = fitted.model.topicsMatrix().toArray()  # vocabulary x topics, at most 2000 x topics
    word_topic = np.exp(digamma(weights) - digamma(weights.sum(axis=0)))

    def update(i: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
        topic = np.exp(digamma(now) - digamma(now.sum()))
        held = word_topic[i]
        return concentration + topic * ((n / (held @ topic + 1e-100)) @ held)

    return update


def topic_certificate(fitted: FittedTopics) -> DataFrame:
    """(ticker, article_count, date_start, date_end, shares_sum, step): are the shares those of the fitted topics?

    A text's shares are a fixed point of the variational update with the topics held: its topic counts, worked out
    once more from its words, must come out again. `step` is the largest mean change of a ticker's texts and
    `shares_sum` the sum that is furthest from one, of the texts with words (null where a ticker has none).
    """
    concentration = fitted.model.estimatedDocConcentration().toArray()
    weights = fitted.model.topicsMatrix().toArray()  # vocabulary x topics, at most 2000 x topics
    word_topic = np.exp(_digamma(weights) - _digamma(weights.sum(axis=0)))

    @F.pandas_udf("double")
    def change(indices: pd.Series, counts: pd.Series, shares: pd.Series) -> pd.Series:
        found = []
        for i, n, share in zip(indices, counts, shares):
            i, n = np.asarray(i, int), np.asarray(n, float)
            topic_counts_ = np.asarray(share) * (concentration.sum() + n.sum())
            topic = np.exp(_digamma(topic_counts_) - _digamma(topic_counts_.sum()))
            again = concentration + topic * ((n / (word_topic[i] @ topic + 1e-100)) @ word_topic[i])
            found.append(float(np.abs(again - topic_counts_).mean()))
        return pd.Series(found, dtype=float)

    checked = text_shares(fitted).select("ticker", "date", "shares", F.unwrap_udt("features").alias("v"))
    checked = checked.select(
        "ticker", "date", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x).alias("sum"), F.size("v.indices").alias("words"),
        change("v.indices", "v.values", "shares").alias("step"),
    )
    off = F.struct(F.abs(F.col("sum") - 1.0).alias("off"), F.col("sum"))
    return checked.groupBy("ticker").agg(
        F.count("*").alias("article_count"),
        F.min("date").cast("string").alias("date_start"),
        F.max("date").cast("string").alias("date_end"),
        F.max(F.when(F.col("words") > 0, off))["sum"].alias("shares_sum"),
        F.max("step").alias("step"),
    )


def empty_topics(spark, status: str, source_file: str = "") -> dict[str, DataFrame]:
    return {
        "topic_words": spark.createDataFrame(
            [(status, source_file, "", None, "", None)],
            "status string, source_file string, topic string, rank int, word string, weight double",
        ),
        "ticker_topics": spark.createDataFrame(
            [(status, source_file, "", 0, "", "", "", None)],
            "status string, source_file string, ticker string, article_count long, date_start string, "
            "date_end string, dominant_topic string, topic_probability double",
        ),
    }


def topic_counts(ticker_topics: DataFrame) -> DataFrame:
    """Tickers per dominant topic."""
    return (
        ticker_topics.where(F.col("status") == "ok")
        .groupBy("dominant_topic")
        .agg(F.count("*").alias("tickers"))
    )

"""Text scoring as column expressions, on whole texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the method: the scoring word lists.
NEGATIVE_WORDS = (
    "abuse", "accident", "allegation", "breach", "bribery", "collapse", "controversy",
    "corruption", "crash", "crisis", "default", "downgrade", "emissions", "fraud",
    "investigation", "lawsuit", "loss", "misconduct", "pollution", "probe", "recall", "risk",
    "scandal", "strike", "violation",
)
POSITIVE_WORDS = (
    "award", "benefit", "clean", "improve", "improved", "positive", "progress", "resolve",
    "resolved", "safe", "settle", "settled", "upgrade",
)
CONTROVERSY_WORDS = (
    "bribery", "corruption", "emissions", "fraud", "governance", "investigation", "lawsuit",
    "misconduct", "pollution", "scandal", "social", "violation",
)
# Fixed values of the method: stop words on top of the general English list.
STOP_WORDS = (
    "a", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or",
    "that", "the", "to", "with",
)
PHRASE_STOP_WORDS = (
    "analysts", "article", "commentary", "company", "coverage", "esg", "external", "faces",
    "firm", "follow", "group", "headlines", "highlights", "linked", "market", "monitor",
    "month", "news", "note", "ongoing", "reports", "review", "risk", "risks", "said", "score",
    "signal", "signals", "text",
)
# Fixed value of the method: words of two letters and more with no digit or accent beside them.
PHRASE_TOKEN = r"\b[a-zA-Z][a-zA-Z]+\b"


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def phrase_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PHRASE_TOKEN), F.lit(0))


def hits(words: Column, lexicon: Sequence[str]) -> Column:
    """Occurrences of lexicon words, repeats counted."""
    return F.size(F.filter(words, lambda word: word.isin(list(lexicon))))


def word_counts(
    words: Column,
    negative: Sequence[str] = NEGATIVE_WORDS,
    positive: Sequence[str] = POSITIVE_WORDS,
    controversy: Sequence[str] = CONTROVERSY_WORDS,
) -> dict[str, Column]:
    return {
        "negative_word_count": hits(words, negative),
        "positive_word_count": hits(words, positive),
        "controversy_keyword_count": hits(words, controversy),
        "token_count": F.size(words),
    }


def word_scores() -> dict[str, Column]:
    """Ratios of the `word_counts` columns; a text without words scores zero."""
    n = F.nullif("token_count", F.lit(0))
    negative, positive = F.col("negative_word_count"), F.col("positive_word_count")

    def ratio(top: Column) -> Column:
        return F.coalesce(top / n, F.lit(0.0))

    return {
        "text_sentiment_score": ratio(positive - negative),
        "negative_sentiment_intensity": ratio(F.greatest(negative - positive, F.lit(0))),
        "controversy_keyword_density": ratio(F.col("controversy_keyword_count")),
        "news_pressure_component": F.when(F.col("token_count") > 0, 1.0).otherwise(0.0),
    }


def negative_controversy_score(intensity: Column, density: Column, articles: Column) -> Column:
    """0 to 100 from sentiment intensity, keyword density and the number of articles."""
    one = F.lit(1.0)
    return F.round(
        100.0
        * (
            0.5 * F.least(one, intensity * 8.0)
            + 0.35 * F.least(one, density * 10.0)
            + 0.15 * F.least(one, F.log1p(F.greatest(articles, F.lit(0))) / F.ln(F.lit(6.0)))
        ),
        2,
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 67, "High").when(score >= 34, "Medium").otherwise("Low")

"""Sentiment from keyword families and from model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions import vocabulary as V
from chatlens.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, first_letters, prefix_tree, whole_words

BULLISH_PATTERNS = [whole_words(f) for f in V.BULLISH_FAMILIES]
BEARISH_PATTERNS = [whole_words(f) for f in V.BEARISH_FAMILIES]
ANY_BULLISH = whole_words(dict.fromkeys(w for f in V.BULLISH_FAMILIES for w in f))
ANY_BEARISH = whole_words(dict.fromkeys(w for f in V.BEARISH_FAMILIES for w in f))

_ALL = list(dict.fromkeys(w for f in (*V.BULLISH_FAMILIES, *V.BEARISH_FAMILIES) for w in f))
_OPTIONS = [w.replace(".?", "[^\\n]?") for w in _ALL if ".?" in w] + [prefix_tree(w for w in _ALL if ".?" not in w)]
# A look-ahead, so that words which begin within another one are found too.
FAMILY_WORD = f"{first_letters(_ALL)}{NOT_AFTER_WORD}(?=({'|'.join(_OPTIONS)}){NOT_BEFORE_WORD})"


def family_words(lower_text: Column) -> Column:
    """All that the scores look for in a lower-cased text, a line for each place: the longest words there.

    Shorter ones of the same place are the beginning of that line, and no word goes
    over its end, so the scores of the text are those of these lines. One pass over
    the text makes them, and the pattern of each family is run on them only.
    """
    return F.array_join(F.regexp_extract_all(lower_text, F.lit(FAMILY_WORD), F.lit(1)), "\n")


def _families_hit(lower_text: Column, any_pattern: str, patterns: list[str]) -> Column:
    score = F.lit(0)
    for pattern in patterns:
        score = score + lower_text.rlike(pattern).cast("int")
    # Most texts hit no family: one pass over a shared pattern settles those.
    return F.when(lower_text.rlike(any_pattern), score).otherwise(F.lit(0))


def bullish_score(lower_text: Column) -> Column:
    return _families_hit(lower_text, ANY_BULLISH, BULLISH_PATTERNS)


def bearish_score(lower_text: Column) -> Column:
    return _families_hit(lower_text, ANY_BEARISH, BEARISH_PATTERNS)


def keyword_sentiment(bullish: Column, bearish: Column) -> Column:
    return (
        F.when(bullish > bearish, F.lit(V.BULLISH))
        .when(bearish > bullish, F.lit(V.BEARISH))
        .otherwise(F.lit(V.NEUTRAL))
    )


def model_choice(positive: Column, negative: Column, neutral: Column) -> Column:
    """Label of the highest score; the earlier label wins a tie."""
    return (
        F.when((positive >= negative) & (positive >= neutral), F.lit(V.BULLISH))
        .when(negative >= neutral, F.lit(V.BEARISH))
        .otherwise(F.lit(V.NEUTRAL))
    )


def model_confidence(positive: Column, negative: Column, neutral: Column) -> Column:
    return F.greatest(positive, negative, neutral)


def blend(choice: Column, confidence: Column, keyword: Column) -> Column:
    """Struct(sentiment, confidence): a model's verdict, helped out by the
    keywords where it is neutral or unsure."""
    unsure = confidence < V.CONFIDENCE_THRESHOLD
    by_keyword = ((choice == V.NEUTRAL) | unsure) & (keyword != V.NEUTRAL)
    sentiment = (
        F.when(by_keyword, keyword).when(unsure, F.lit(V.NEUTRAL)).otherwise(choice)
    )
    score = F.when(by_keyword, F.greatest(confidence, F.lit(V.KEYWORD_CONFIDENCE))).otherwise(
        confidence
    )
    return F.struct(sentiment.alias("sentiment"), score.alias("confidence"))

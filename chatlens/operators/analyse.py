"""Message analysis: messages in, one analysis row each out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import keypoints, sentiment, tokens, topics
from chatlens.functions import vocabulary as V
from chatlens.functions.text import strip
from chatlens.sources import schemas as S

STRICT, LEXICON = "strict", "lexicon"


# Working columns. Each holds a text or score that several expressions read; as
# columns of their own they are computed once per row, where an expression
# repeated inside a conditional would be computed at every mention.
_BODY, _UPPER, _CLEAN, _LOW = "_body", "_upper", "_clean", "_low"
_WORDS = "_words"
_BULL, _BEAR, _KEYWORD, _VERDICT = "_bull", "_bear", "_keyword", "_verdict"
_WORK = (_BODY, _UPPER, _CLEAN, _LOW, _WORDS, _BULL, _BEAR, _KEYWORD, _VERDICT, "_from_reply")


def _staged(df: DataFrame, text: str) -> DataFrame:
    if _BODY in df.columns:
        return df
    return df.withColumn(_BODY, strip(F.col(text))).withColumn(_UPPER, F.upper(_BODY))


def _tokens(df: DataFrame, text: str) -> DataFrame:
    return _staged(df, text).withColumn("tokens", tokens.tokens(F.col(_UPPER)))


def _flags(df: DataFrame, text: str) -> DataFrame:
    body = F.col(_BODY)
    return _tokens(df, text).withColumns(
        {
            "is_investment": tokens.is_investment(F.col("tokens"), body),
            "topic_key": topics.topic_key(F.col("tokens"), body),
        }
    )


def _verdict(df: DataFrame, text: str, mode: str) -> DataFrame:
    scored = {"positive", "negative", "neutral"} <= set(df.columns)
    neutral, nothing = F.lit(V.NEUTRAL), F.lit(None).cast("double")
    active = F.col("is_investment") & (F.col(_BODY) != "")
    df = _staged(df, text)
    if scored or mode == LEXICON:
        words = F.col(_WORDS)
        df = df.withColumn(_WORDS, F.when(active, sentiment.family_words(F.lower(_BODY)))).withColumns(
            {
                _BULL: F.when(active, sentiment.bullish_score(words)),
                _BEAR: F.when(active, sentiment.bearish_score(words)),
            }
        ).withColumn(_KEYWORD, sentiment.keyword_sentiment(F.col(_BULL), F.col(_BEAR)))
    label = F.col(_KEYWORD)
    without_model = (
        F.struct(neutral.alias("sentiment"), F.lit(0.0).alias("confidence"))
        if mode == STRICT
        else sentiment.blend(neutral, F.lit(0.0), label)
    )
    verdict = without_model
    if scored:
        p, n, u = F.col("positive"), F.col("negative"), F.col("neutral")
        by_model = sentiment.blend(
            sentiment.model_choice(p, n, u), sentiment.model_confidence(p, n, u), label
        )
        verdict = F.when(p.isNotNull() & n.isNotNull() & u.isNotNull(), by_model).otherwise(verdict)
    if "model_failed" in df.columns:
        failed = F.struct(neutral.alias("sentiment"), F.lit(0.0).alias("confidence"))
        verdict = F.when(F.col("model_failed"), failed).otherwise(verdict)
    idle = F.struct(neutral.alias("sentiment"), nothing.alias("confidence"))
    return df.withColumn(_VERDICT, F.when(active, verdict).otherwise(idle)).withColumns(
        {"sentiment": F.col(f"{_VERDICT}.sentiment"), "confidence": F.col(f"{_VERDICT}.confidence")}
    )


def _key_points(df: DataFrame, text: str) -> DataFrame:
    none = F.array().cast("array<string>")
    df = _staged(df, text)
    wanted = F.col("is_investment")
    if "reply" in df.columns:
        df = df.withColumn("_from_reply", keypoints.reply_points(F.col("reply")))
        wanted = wanted & (F.size("_from_reply") == 0)
    df = df.withColumn(_CLEAN, F.when(wanted, keypoints.clean_text(F.col(_BODY)))).withColumn(_LOW, F.lower(_CLEAN))
    from_text = F.when(F.col(_CLEAN).isNotNull(), keypoints.text_points(F.col(_CLEAN), low=F.col(_LOW))).otherwise(none)
    if "reply" in df.columns:
        from_text = keypoints.choose_points(F.col("is_investment"), F.col("_from_reply"), from_text)
    return df.withColumn("key_points", from_text)


def with_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``."""
    return _tokens(df, text).drop(*_WORK)


def with_flags(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``tokens``, ``is_investment`` and ``topic_key``."""
    return _flags(df, text).drop(*_WORK)


def with_verdict(df: DataFrame, text: str = "text", mode: str = STRICT) -> DataFrame:
    """Adds ``sentiment`` and ``confidence`` to a frame that holds
    ``is_investment`` and, if a model ran, the columns positive, negative, neutral.

    ``strict``: without scores a message stays neutral with confidence zero.
    ``lexicon``: without scores the keyword families decide alone.
    """
    return _verdict(_staged(df, text), text, mode).drop(*_WORK)


def annotate(df: DataFrame, text: str = "text", mode: str = STRICT) -> DataFrame:
    """All analysis columns beside the input columns, in one pass without a shuffle."""
    return _key_points(_verdict(_flags(df, text), text, mode), text).drop(*_WORK)


def analyse(
    messages: DataFrame,
    analyzed_at: Column,
    scores: DataFrame | None = None,
    replies: DataFrame | None = None,
    mode: str = STRICT,
    model_version: int = V.MODEL_VERSION,
) -> DataFrame:
    """Analysis rows of messages.

    ``scores`` and ``replies`` are tables keyed like messages, made by models
    elsewhere; both joins are equi-joins on the primary key, so they need no
    shuffle if the tables are bucketed by it.
    """
    df = messages.select(*S.KEY, "text")
    if scores is not None:
        df = df.join(scores.select(*S.KEY, "positive", "negative", "neutral"), S.KEY, "left")
    if replies is not None:
        df = df.join(replies.select(*S.KEY, "reply"), S.KEY, "left")
    done = annotate(df, mode=mode).withColumns(
        {"model_version": F.lit(model_version), "analyzed_at": analyzed_at}
    )
    return S.conform(done, S.ANALYSIS)

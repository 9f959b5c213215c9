"""Filters, joins and projections of the query side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.sources import schemas as S

NEWEST_FIRST = [("ts_utc", False), ("message_id", False)]


def newest_first() -> list[Column]:
    return [F.col(name).asc() if up else F.col(name).desc() for name, up in NEWEST_FIRST]


def of_chat(df: DataFrame, chat_id: int) -> DataFrame:
    return df.where(F.col("chat_id") == F.lit(chat_id))


def in_range(df: DataFrame, start, end, column: str = "ts_utc") -> DataFrame:
    """Rows with start <= column <= end."""
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def with_analysis(messages: DataFrame, analysis: DataFrame) -> DataFrame:
    """Messages with their analysis, if there is one."""
    return messages.join(analysis, S.KEY, "left")


def needs_reanalysis(messages: DataFrame, analysis: DataFrame) -> DataFrame:
    """Edited messages never analysed since the edit: key and edit date.

    Only edited messages enter the join, and only two columns of either side.
    """
    edited = messages.where(F.col("edit_date").isNotNull()).select(*S.KEY, "edit_date")
    stale = F.col("analyzed_at").isNull() | (F.col("edit_date") > F.col("analyzed_at"))
    return (
        edited.join(analysis.select(*S.KEY, "analyzed_at"), S.KEY, "left")
        .where(stale)
        .select(*S.KEY, "edit_date")
    )


def topic_matches(topic: Column) -> Column:
    """Topic key holds the text (any case), or it is one of the tokens."""
    in_key = F.contains(F.lower("topic_key"), F.lower(topic))
    in_tokens = F.array_contains(F.col("tokens"), F.upper(topic))
    return F.coalesce(in_key, F.lit(False)) | F.coalesce(in_tokens, F.lit(False))


def newest(df: DataFrame, limit: int | None) -> DataFrame:
    """The ``limit`` newest rows; all rows, unsorted, without a limit."""
    return df if limit is None else df.orderBy(*newest_first()).limit(limit)


def report_columns(df: DataFrame) -> DataFrame:
    """Columns that reports use, with the defaults of rows not yet analysed."""
    no_texts = F.array().cast("array<string>")
    return df.select(
        *S.KEY,
        "ts_utc",
        "from_username",
        "text",
        F.coalesce("is_investment", F.lit(False)).alias("is_investment"),
        "sentiment",
        F.coalesce("tokens", no_texts).alias("tokens"),
        F.coalesce("key_points", no_texts).alias("key_points"),
        "topic_key",
    )


def report_frame(
    messages: DataFrame,
    analysis: DataFrame,
    chat_id: int,
    start,
    end,
    topic: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Rows of one report: chat, time range, topic, then the newest ``limit``.

    Chat and time filters reach the scan of messages. Analysis rows carry no
    message time; a caller with stored tables cuts them to the same days by
    their partitions. The limit comes before any aggregate, as a top-n that
    keeps ``limit`` rows per task.
    """
    found = in_range(of_chat(messages, chat_id), start, end)
    joined = with_analysis(found, of_chat(analysis, chat_id))
    if topic:
        joined = joined.where(topic_matches(F.lit(topic)))
    return newest(report_columns(joined), limit)

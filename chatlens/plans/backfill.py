"""Backfill: what is still to be read, in which ranges, and how far it went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.vocabulary import BATCH_SIZE
from chatlens.sources.session import MAX_BROADCAST_ROWS, lookup

# Ranges made per row of the outer step of a plan.
_SPAN = 1000


def bounds(marks: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per chat: first id to read (1 without a checkpoint) and last."""
    done = checkpoints.select("chat_id", "last_message_id")
    return (
        marks.select("chat_id", F.col("message_id").alias("last_id"))
        .join(done, "chat_id", "left")
        .select(
            "chat_id",
            (F.coalesce("last_message_id", F.lit(0).cast("long")) + 1).alias("first_id"),
            "last_id",
        )
        .where(F.col("first_id") <= F.col("last_id"))
    )


def pending(messages: DataFrame, marks: DataFrame, checkpoints: DataFrame,
            max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Messages with text after the checkpoint and up to the high-water mark."""
    todo = bounds(marks, checkpoints)
    joined = lookup(
        messages.where(F.length("text") > 0), todo, ["chat_id"], max_rows, "inner"
    )
    return joined.where(F.col("message_id").between(F.col("first_id"), F.col("last_id"))).drop(
        "first_id", "last_id"
    )


def plan(todo: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Consecutive id ranges (chat_id, from_id, to_id); the last one is clipped.

    Expanded in two steps with a shuffle between, so the ranges of one very
    long chat are made by many tasks and no array grows with the chat.
    """
    stride = batch_size * _SPAN
    spans = todo.select(
        "chat_id", "last_id",
        F.explode(F.sequence("first_id", "last_id", F.lit(stride).cast("long"))).alias("span"),
    ).repartition("chat_id", "span")
    starts = F.sequence(
        "span", F.least(F.col("span") + stride - 1, F.col("last_id")), F.lit(batch_size).cast("long")
    )
    return spans.select("chat_id", "last_id", F.explode(starts).alias("from_id")).select(
        "chat_id", "from_id",
        F.least(F.col("from_id") + batch_size - 1, F.col("last_id")).alias("to_id"),
    )

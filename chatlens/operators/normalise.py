"""Raw source rows to messages rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions import vocabulary as V
from chatlens.functions.text import SPACE, strip
from chatlens.sources import schemas as S
from chatlens.sources.session import MAX_BROADCAST_ROWS, lookup, sized


def with_text(raw: DataFrame) -> DataFrame:
    """Rows that carry any text."""
    return raw.where(F.length("message") > 0)


def urls(entities: Column) -> Column:
    """Links of the entities that have one, in source order, repeats kept."""
    linked = F.filter(entities, lambda e: F.coalesce(e["url"], F.lit("")) != "")
    return F.coalesce(F.transform(linked, lambda e: e["url"]), F.array().cast("array<string>"))


def author_split(message: Column) -> Column:
    """Struct(author, text): a short first line of several is the author's name."""
    parts = F.split(strip(message), "\n", 2)
    first = strip(F.get(parts, F.lit(0)))
    low = F.lower(first)
    plausible = (F.size(parts) > 1) & (F.length(first) <= V.AUTHOR_LINE_CHARS)
    plausible = plausible & (
        F.size(F.split(first, f"{SPACE}+", V.AUTHOR_LINE_WORDS + 2)) <= V.AUTHOR_LINE_WORDS
    )
    for stop in V.AUTHOR_LINE_STOPS:
        plausible = plausible & ~F.contains(low, F.lit(stop))
    return F.struct(
        F.when(plausible, first).alias("author"),
        F.when(plausible, strip(F.get(parts, F.lit(1)))).otherwise(message).alias("text"),
    )


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def with_sender(
    raw: DataFrame, users: DataFrame, max_rows: int | None = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Adds ``handle``: that of a sender who is a user and has one."""
    handles = users.where((F.col("kind") == "user") & (F.col("username") != "")).select(
        F.col("user_id").alias("sender_id"), F.col("username").alias("handle")
    )
    return lookup(raw, handles, ["sender_id"], max_rows)


def with_forward(raw: DataFrame, entities: DataFrame, max_rows: int | None = MAX_BROADCAST_ROWS) -> DataFrame:
    """Adds ``is_forwarded`` and ``forward_from``."""
    origins = entities.select(
        F.col("entity_id").alias("_from_id"),
        F.coalesce("title", "username").alias("_origin"),
        F.lit(True).alias("_known"),
    )
    named = _filled(F.col("forward.from_name"))
    found = lookup(
        raw.withColumn("_from_id", F.when(named.isNull(), F.col("forward.from_id"))),
        origins, ["_from_id"], max_rows,
    )
    by_id = F.when(F.col("_known"), F.col("_origin")).otherwise(F.col("_from_id").cast("string"))
    return found.withColumns(
        {"is_forwarded": F.col("forward").isNotNull(), "forward_from": F.coalesce(named, by_id)}
    ).drop("_from_id", "_origin", "_known")


def normaliser(
    users: DataFrame, entities: DataFrame, max_rows: int = MAX_BROADCAST_ROWS
) -> Callable[[DataFrame], DataFrame]:
    """``normalise`` for many batches: the directories are counted once, now."""
    people, origins = sized(users, max_rows), sized(entities, max_rows)
    return lambda raw: normalise(raw, people, origins, None)


def normalise(
    raw: DataFrame, users: DataFrame, entities: DataFrame, max_rows: int | None = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Messages rows, with ``ingest_seq`` carried along if the source has it."""
    texts = with_text(raw)
    joined = with_sender(with_forward(texts, entities, max_rows), users, max_rows)
    rows = joined.withColumn("_split", author_split(F.col("message"))).select(
        "chat_id",
        F.col("id").alias("message_id"),
        F.col("date").cast("timestamp").alias("ts_utc"),
        F.nullif(F.col("sender_id"), F.lit(0).cast("long")).alias("from_user_id"),
        F.coalesce(_filled(F.col("_split.author")), "handle").alias("from_username"),
        "is_forwarded",
        "forward_from",
        F.col("_split.text").alias("text"),
        urls(F.col("entities")).alias("urls"),
        F.col("reply_to_msg_id").alias("reply_to_id"),
        F.col("edit_date").cast("timestamp").alias("edit_date"),
        F.lit(None).cast("timestamp").alias("created_at"),
        *(["ingest_seq"] if "ingest_seq" in raw.columns else []),
    )
    return rows


def stamp_utc(c: Column) -> Column:
    """The instant that a zone-less UTC time names, in a session of any zone."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), c.cast("timestamp_ntz"))
    return local.cast("timestamp")

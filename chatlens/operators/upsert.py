"""Upserts as one aggregation per primary key.

Each fold combines on the map side, so a key that arrives a million times
still sends one row per task, and the text columns are shuffled once.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.sources import schemas as S

EDITABLE = ["text", "edit_date", "urls"]
SEQ = "ingest_seq"
STORED_SEQ = -1


def _edit_order(seq: list[str]) -> Column:
    """Newest edit wins and its first arrival; with no edit the last arrival."""
    edited = F.col("edit_date").isNotNull()
    sign = F.when(edited, F.lit(-1)).otherwise(F.lit(1))
    return F.struct(edited, F.col("edit_date"), *[F.col(c) * sign for c in seq])


def fold_messages(arrivals: DataFrame, seq: list[str] | None = None) -> DataFrame:
    """State of the messages table after all arrivals in the order of ``seq``.

    Text, edit date and links follow the edit rule; all else stays as it first
    arrived.
    """
    seq = seq or [SEQ]
    columns = [c for c in arrivals.columns if c not in {*S.KEY, *seq}]
    frozen = [c for c in columns if c not in EDITABLE]
    folded = arrivals.groupBy(*S.KEY).agg(
        F.min_by(F.struct(*frozen), F.struct(*seq)).alias("_first"),
        F.max_by(F.struct(*EDITABLE), _edit_order(seq)).alias("_edit"),
    )
    return folded.select(
        *S.KEY, *[F.col(f"{'_edit' if c in EDITABLE else '_first'}.{c}").alias(c) for c in columns]
    )


def fold_versions(
    rows: DataFrame, keys: list[str], first: list[str], last: list[str], places: bool = True
) -> DataFrame:
    """``fold_messages`` for rows that may be folds themselves, and that can be folded again.

    ``first`` is the place of the arrival that the fixed columns are from,
    ``last`` that of the edit; a row as it arrived has both the same. They stay
    with what they placed, so the fold is one of sets: any order, any grouping
    and any repetition give the same. Without ``places`` they only order the rows and
    are left out of what is carried, for results that are not folded again.
    """
    columns = [c for c in rows.columns if c not in {*keys, *first, *last}]
    frozen = [c for c in columns if c not in EDITABLE]
    of_first, of_edit = (first, last) if places else ([], [])
    folded = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*frozen, *of_first), F.struct(*first)).alias("_first"),
        F.max_by(F.struct(*EDITABLE, *of_edit), _edit_order(last)).alias("_edit"),
    )
    side = lambda c: "_edit" if c in EDITABLE or c in last else "_first"
    return folded.select(*keys, *[F.col(f"{side(c)}.{c}").alias(c) for c in [*columns, *of_first, *of_edit]])


def text_order(seq: list[str], redone: str) -> Column:
    """Order of analysis rows whose greatest belongs to the text that the edit rule keeps.

    ``redone`` marks an analysis of the stored text made later. It stands in for
    the one of its edit, but not for that of a newer edit or arrival.
    """
    edited = F.col("edit_date").isNotNull()
    again = edited & F.coalesce(F.col(redone), F.lit(False))
    sign = F.when(edited & ~again, F.lit(-1)).otherwise(F.lit(1))
    return F.struct(edited, F.col("edit_date"), again, *[F.col(c) * sign for c in seq])


def fold_by(rows: DataFrame, keys: list[str], order: list[Column], without: Collection[str] = ()) -> DataFrame:
    """Row of each key that is greatest in ``order``, all columns kept but those of ``without``."""
    rest = [c for c in rows.columns if c not in {*keys, *without}]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def fold_latest(
    arrivals: DataFrame, keys: list[str] | None = None, seq: list[str] | None = None
) -> DataFrame:
    """Last arrival of each key, whole row."""
    keys, seq = keys or S.KEY, seq or [SEQ]
    rest = [c for c in arrivals.columns if c not in {*keys, *seq}]
    return (
        arrivals.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def _before(stored: DataFrame) -> DataFrame:
    """Stored rows count as having arrived before everything new."""
    return stored.withColumn(SEQ, F.lit(STORED_SEQ).cast("long"))


def merge_messages(stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    return fold_messages(_before(stored).unionByName(arrivals))


def merge_latest(stored: DataFrame, arrivals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return fold_latest(_before(stored).unionByName(arrivals), keys)


def high_water_marks(messages: DataFrame, chats: DataFrame, now: Column) -> DataFrame:
    """Newest message of every listed chat; id zero and ``now`` for empty ones.

    Messages are cut to one row per chat before anything is joined.
    """
    newest = messages.groupBy("chat_id").agg(
        F.max(F.struct("message_id", "ts_utc")).alias("_newest")
    )
    return chats.select("chat_id").join(newest, "chat_id", "left").select(
        "chat_id",
        F.coalesce("_newest.message_id", F.lit(0).cast("long")).alias("message_id"),
        F.coalesce("_newest.ts_utc", now).alias("ts_utc"),
        now.alias("created_at"),
    )


def checkpoints(processed: DataFrame, now: Column) -> DataFrame:
    """Checkpoint rows: the greatest message id handled in each chat."""
    return (
        processed.groupBy("chat_id")
        .agg(F.max(F.struct("message_id", "ts_utc")).alias("_last"))
        .select(
            "chat_id",
            F.col("_last.message_id").alias("last_message_id"),
            F.col("_last.ts_utc").alias("last_ts_utc"),
            now.alias("updated_at"),
        )
    )

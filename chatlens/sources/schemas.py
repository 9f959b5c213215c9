"""Declared schemas of all tables; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.functions.vocabulary import MODEL_VERSION

_long, _text, _time, _flag = T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType()
_texts = T.ArrayType(_text)


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


RAW_MESSAGE = _schema(
    ("chat_id", _long, False),
    ("id", _long, False),
    ("date", _time, False),
    ("message", _text, True),
    ("entities", T.ArrayType(T.StructType([T.StructField("url", _text)])), True),
    ("sender_id", _long, True),
    ("forward", T.StructType([T.StructField("from_name", _text), T.StructField("from_id", _long)]), True),
    ("reply_to_msg_id", _long, True),
    ("edit_date", _time, True),
    ("ingest_seq", _long, True),
)

MESSAGES = _schema(
    ("chat_id", _long, False),
    ("message_id", _long, False),
    ("ts_utc", _time, False),
    ("from_user_id", _long, True),
    ("from_username", _text, True),
    ("is_forwarded", _flag, True),
    ("forward_from", _text, True),
    ("text", _text, False),
    ("urls", _texts, True),
    ("reply_to_id", _long, True),
    ("edit_date", _time, True),
    ("created_at", _time, True),
)

ANALYSIS = _schema(
    ("chat_id", _long, False),
    ("message_id", _long, False),
    ("is_investment", _flag, False),
    ("sentiment", _text, False),
    ("tokens", _texts, True),
    ("topic_key", _text, False),
    ("key_points", _texts, True),
    ("confidence", T.DoubleType(), True),
    ("model_version", T.IntegerType(), True),
    ("analyzed_at", _time, True),
)

INGEST_CHECKPOINT = _schema(
    ("chat_id", _long, False),
    ("last_message_id", _long, False),
    ("last_ts_utc", _time, False),
    ("updated_at", _time, True),
)

HIGH_WATER_MARKS = _schema(
    ("chat_id", _long, False),
    ("message_id", _long, False),
    ("ts_utc", _time, False),
    ("created_at", _time, True),
)

#: Which message was edited when, with the partition that holds it.
EDITS = _schema(
    ("chat_id", _long, False),
    ("message_id", _long, False),
    ("edit_date", _time, False),
    ("chat_bucket", T.IntegerType(), False),
    ("day", T.DateType(), False),
)

#: Counts of one batch of the ingest.
INGEST_LOG = _schema(
    ("rows_read", _long, True), ("rows_bad", _long, True), ("rows_analysed", _long, True), ("rescan", _flag, True),
)

KEY = ["chat_id", "message_id"]


def names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones become null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def with_message_defaults(df: DataFrame, now: Column) -> DataFrame:
    """Column defaults of the messages table."""
    return df.withColumns(
        {
            "is_forwarded": F.coalesce("is_forwarded", F.lit(False)),
            "created_at": F.coalesce("created_at", now),
        }
    )


def with_analysis_defaults(df: DataFrame, now: Column) -> DataFrame:
    """Column defaults of the analysis table."""
    return df.withColumns(
        {
            "model_version": F.coalesce("model_version", F.lit(MODEL_VERSION)),
            "analyzed_at": F.coalesce("analyzed_at", now),
        }
    )

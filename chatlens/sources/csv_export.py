"""CSV form of a report's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators.relational import newest_first
from chatlens.sources.codecs import time_to_iso

COLUMNS = (
    "message_id", "timestamp", "username", "text", "is_investment",
    "sentiment", "tokens", "topic_key", "key_points",
)
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def export_frame(report: DataFrame) -> DataFrame:
    """Export columns, lists joined, newest message first."""
    blank = F.lit("")
    return report.orderBy(*newest_first()).select(
        "message_id",
        time_to_iso(F.col("ts_utc")).alias("timestamp"),
        F.coalesce("from_username", blank).alias("username"),
        "text",
        F.when(F.col("is_investment"), "True").otherwise("False").alias("is_investment"),
        F.coalesce("sentiment", blank).alias("sentiment"),
        F.array_join(F.array_compact("tokens"), ", ").alias("tokens"),
        F.coalesce("topic_key", blank).alias("topic_key"),
        F.array_join(F.array_compact("key_points"), "; ").alias("key_points"),
    )


def write_csv(report: DataFrame, path: str) -> None:
    """A folder of CSV parts in report order; nothing passes through the driver."""
    export_frame(report).write.mode("errorifexists").options(
        **_OPTIONS, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reads an export back; texts may hold line feeds."""
    return spark.read.schema(SCHEMA).options(
        **_OPTIONS, multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)

"""Scans of messages: by id, by time, by lookup, and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatlens.sources import schemas as S
from chatlens.sources.session import MAX_BROADCAST_ROWS, is_small


def by_id(messages: DataFrame, min_id: int = 0, max_id: int | None = None, limit: int | None = None,
          column: str = "message_id") -> DataFrame:
    """min_id < id <= max_id with text; the ``limit`` lowest ids if asked for."""
    rows = messages.where((F.col(column) > min_id) & (F.length("text") > 0))
    if max_id is not None:
        rows = rows.where(F.col(column) <= max_id)
    return rows if limit is None else rows.orderBy(column).limit(limit)


def by_time(messages: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """start <= ts_utc <= end with text; the ``limit`` oldest if asked for."""
    rows = messages.where(
        F.col("ts_utc").between(F.lit(start), F.lit(end)) & (F.length("text") > 0)
    )
    return rows if limit is None else rows.orderBy("ts_utc", "message_id").limit(limit)


def by_ids(messages: DataFrame, wanted: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Messages whose key is listed; a short list travels to the scan, a long
    one is met by shuffle on the unique key."""
    keys = wanted.select(*S.KEY).distinct()
    return messages.join(F.broadcast(keys) if is_small(keys, max_rows) else keys, S.KEY, "left_semi")


def stream(spark: SparkSession, path: str, schema: StructType = S.RAW_MESSAGE,
           files_per_trigger: int | None = None, file_format: str = "parquet",
           glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream of source rows."""
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def edits(arrivals: DataFrame) -> DataFrame:
    return arrivals.where(F.col("edit_date").isNotNull())

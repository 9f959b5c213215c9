"""Helpers of several operators: durable cuts, global ranks, row tables, blocks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A run of ASCII white space; words are what lies between.
SPACE = r"[\x20\x09-\x0D]+"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A batch ends with the row that reaches so many bytes.
BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Few bytes in an Arrow batch for what runs within, where rows are large or Python keeps much beside them.

    A batch stands in the JVM and in Python at once, for each task, and up to 64 MB of it otherwise.
    """
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def table(df: DataFrame, purpose: str, options: Mapping = {}) -> DataFrame:
    """Write a frame once to the shared folder and read it back: lineage ends here."""
    path = f"{shared_folder(df.sparkSession)}/{purpose}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, purpose: str, keys: list[str]) -> DataFrame:
    """Like ``table``, in the warehouse and bucketed: a join on ``keys`` then moves the other side only.

    ``df`` should be dealt by ``keys`` to ``partitions(df)`` already, so that each task writes one bucket.
    """
    name = f"llm_{purpose}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(partitions(df), *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame with a checkpoint that Spark's cleaner removes."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


#: Rows up to which a frame that was counted may be broadcast.
MAX_BROADCAST_ROWS = 200_000


def small_or_whole(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """The frame, marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_KEEP = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all other code points."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    parts = F.array_remove(F.split(text, SPACE), "")  # linear, where counting matches copies the text for each
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")


def ranked(df: DataFrame, order: list[Column], within: str | None, name: str) -> DataFrame:
    """Number rows from 0 in ``order``, within each value of column ``within`` or overall.

    ``order`` must start with ``within`` where it is given, and should end in
    something unique. The rows are dealt by ranges of the whole order, sorted in
    place and cut; their place in their own partition comes from Spark's running
    id, and each partition needs only the counts of those before it: at most one
    number for each partition and value that it holds. So a value with a third
    of all rows spreads over a third of the partitions, and no window sees it.
    """
    run, part, group = fresh(df, "_run"), fresh(df, "_part"), fresh(df, "_group")
    of_group = F.col(within) if within else F.lit(0)
    placed = cut(
        df.repartitionByRange(partitions(df), *order)
        .sortWithinPartitions(*order)
        .withColumn(run, F.monotonically_increasing_id())
        .withColumn(part, F.spark_partition_id())
    )
    p, g, shift = fresh(df, "_p"), fresh(df, "_g"), fresh(df, "_shift")
    counts = placed.groupBy(part, of_group.alias(group)).agg(
        F.count("*").alias("_n"), F.min(run).alias("_first")
    )
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(part).alias(p),
        F.col(group).alias(g),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias(shift),
    )
    found = placed.join(
        small_or_whole(offsets),
        (placed[part] == offsets[p])
        & (placed[within] if within else F.lit(0)).eqNullSafe(offsets[g]),
    )
    return found.withColumn(name, F.col(run) + F.col(shift)).drop(run, part, p, g, shift)

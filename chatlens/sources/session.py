"""Session helpers: shared scratch folder, durable cut points, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
MAX_BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session that names none gets a temporary folder: there the
    driver and the executors are one machine.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_SETTING} must name a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of our own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of our own once nothing reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete(spark: SparkSession, files: Iterable[str]) -> None:
    """Delete files by the addresses that ``_metadata.file_path`` gives; those gone already are passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for file in files:
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        target.getFileSystem(conf).delete(target, False)


def written(df: DataFrame, purpose: str) -> tuple[str, DataFrame]:
    """A frame written to a scratch folder, and that folder, for callers that discard it."""
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame once to the shared folder and go on from the files.

    For results that several branches of a plan read: they all scan the same
    narrow files, lost executors cost nothing, and the reader gets exact
    file statistics for its join choices.
    """
    return written(df, purpose)[1]


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for the writes within, put back afterwards; one that the user made stays."""
    if spark.sparkContext.getConf().contains(name):
        yield
        return
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan of few, small files some partitions for each core.

    Text functions are bound by processor time, and one small file is one task.
    Spark cuts tables into a piece of bytes per core as long as such a piece is below
    ``maxPartitionBytes``; row groups are not cut, so pieces smaller than these
    are mostly empty and some cores have nothing to do. Only a scan with clearly more
    pieces than cores is of pieces of full size and left alone, so large
    tables are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a frame has at most ``max_rows`` rows; counts no further."""
    return df.limit(max_rows + 1).count() <= max_rows


def sized(dimension: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A lookup table, marked for broadcast if a count shows that it is small, else for a shuffle.

    Left to itself Spark goes by the size of files, and ten megabytes of repeating
    values, or of rows that a later step multiplies, may fill the memory of the driver.
    """
    return F.broadcast(dimension) if is_small(dimension, max_rows) else shuffled(dimension)


def shuffled(df: DataFrame) -> DataFrame:
    """A frame that grows with the data, marked so that no join with it is a broadcast."""
    return df.hint("merge")


def lookup(
    facts: DataFrame, dimension: DataFrame, on: list[str], max_rows: int | None = MAX_BROADCAST_ROWS, how: str = "left"
) -> DataFrame:
    """Equi-join of a large frame with a lookup table.

    A table of checked small size is broadcast. A larger one is joined by
    shuffle; Spark's adaptive skew join then splits the partition of a hot key,
    null included, on the side of ``facts`` for left and inner joins alike, by the
    bytes it really has. Without ``max_rows`` the table is taken as it is: ``sized``
    before, or for Spark to choose.
    """
    return facts.join(dimension if max_rows is None else sized(dimension, max_rows), on, how)

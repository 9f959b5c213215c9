"""Parquet tables of a chat store, kept up to date by appending.

Messages and their analysis lie in folders by a hash bucket of the chat and by
the day of the message, so chat and time filters choose folders. A merge appends
its rows to the partitions they belong to and reads nothing. Every row carries
the place of its arrival, and readers fold the arrivals of a key after their
filters chose the folders. The fold keeps those places, so folding what was
folded already, together with any part of what it came from, changes nothing.
``settle`` relies on that: it appends the fold of a partition and only then
deletes the files it read. Wherever it stops, all rows are there.
"""

from __future__ import annotations

import time
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.operators import upsert
from chatlens.sources import schemas as S
from chatlens.sources.session import delete, discard, setting, written

BUCKETS = 16
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
BUCKET, DAY, EDIT_DAY = "chat_bucket", "day", "edit_day"

#: Time of the merge and place within it, of the first arrival and of the one that counts.
FIRST, LAST = ["first_merge", "first_seq"], ["last_merge", "last_seq"]
#: Whether a file was written by ``settle``.
FOLDED = "folded"
_ORDER = T.StructType([*[T.StructField(c, T.LongType()) for c in (*FIRST, *LAST)], T.StructField(FOLDED, T.BooleanType())])
#: Which analysis of a message counts: that of its last arrival, or that of the text in the messages table.
OF_ARRIVAL, OF_STORED = "arrival", "stored"
#: Edit that an analysis is of, and whether it was made of the stored text.
REDONE = "redone"
_OF_TEXT = T.StructType([T.StructField("edit_date", T.TimestampType()), T.StructField(REDONE, T.BooleanType())])

def _unplaced(places: bool) -> tuple[str, ...]:
    return () if places else (*FIRST, *LAST)


def _edit_rule(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    return upsert.fold_versions(rows, keys, FIRST, LAST, places)


def _last_wins(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    return upsert.fold_by(rows, keys, [F.col(c) for c in LAST], _unplaced(places))


def _of_stored_text(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    return upsert.fold_by(rows, keys, [upsert.text_order(LAST, REDONE)], _unplaced(places))


def _furthest(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    return upsert.fold_by(rows, keys, [F.col("last_message_id"), *[F.col(c) for c in LAST]], _unplaced(places))


def _first(rows: DataFrame, keys: list[str], places: bool) -> DataFrame:
    """A mark is set once; asking again does not move it."""
    return upsert.fold_by(rows, keys, [-F.col(c) for c in LAST], _unplaced(places))


# Schema, fold, key, partition columns.
_TABLES = {
    "messages": (S.MESSAGES, _edit_rule, S.KEY, [BUCKET, DAY]),
    "analysis": (S.ANALYSIS, _last_wins, S.KEY, [BUCKET, DAY]),
    "edits": (S.EDITS, _last_wins, [*S.KEY, "edit_date"], [EDIT_DAY]),
    "ingest_checkpoint": (S.INGEST_CHECKPOINT, _furthest, ["chat_id"], [BUCKET]),
    "high_water_marks": (S.HIGH_WATER_MARKS, _first, ["chat_id"], [BUCKET]),
}
_PART_TYPES = {BUCKET: T.IntegerType(), DAY: T.DateType(), EDIT_DAY: T.DateType()}


def day_of(ts: Column | str) -> Column:
    return F.to_date(ts)


def as_column(bound) -> Column:
    return bound if isinstance(bound, Column) else F.lit(bound)


def between_days(start=None, end=None, column: str = DAY) -> Column:
    """Condition on a partition column; a bound may be a date, a time or a column."""
    found = F.lit(True)
    for bound, keep in ((start, F.col(column).__ge__), (end, F.col(column).__le__)):
        if bound is not None:
            value = as_column(bound)
            found = found & keep(value if type(bound) is date else day_of(value))
    return found


class ChatTables:
    """The tables below one root folder that all executors can reach.

    ``buckets`` and ``analysis_of`` are fixed for the life of a store. With
    ``OF_STORED`` the analysis follows the edit rule as the messages do, so a
    stale replay after an edit changes neither; every row of it carries the edit
    it is of, so this takes no look at the messages. A message keeps its
    ``ts_utc``: edits and replays carry that of the first arrival. What a later
    merge brings counts as having arrived later, by the clock of its driver.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, analysis_of: str = OF_ARRIVAL):
        if analysis_of not in (OF_ARRIVAL, OF_STORED):
            raise ValueError(f"analysis_of is {analysis_of!r}, not {OF_ARRIVAL!r} or {OF_STORED!r}")
        self.spark = spark
        self.analysis_of = analysis_of
        self.root = root.rstrip("/")
        self.buckets = buckets

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def bucket_of(self, chat_id: Column) -> Column:
        return F.pmod(F.xxhash64(chat_id.cast("long")), F.lit(self.buckets)).cast("int")

    def _schema(self, name: str) -> T.StructType:
        schema, _, _, parts = _TABLES[name]
        more = _OF_TEXT.fields if name == "analysis" else []
        return T.StructType([*schema.fields, *more, *_ORDER.fields, *[T.StructField(p, _PART_TYPES[p]) for p in parts]])

    def stored(self, name: str) -> DataFrame:
        """All arrivals as they lie in the files that are there now; an empty frame before the first merge."""
        return self._read(self.path(name), self._schema(name))

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _fold(self, name: str, arrivals: DataFrame, places: bool = True) -> DataFrame:
        _, fold, key, parts = _TABLES[name]
        if name == "analysis" and self.analysis_of == OF_STORED:
            fold = _of_stored_text
        return fold(arrivals.drop(FOLDED), [*parts, *key], places)

    def state(self, name: str, where: Column | None = None, only: DataFrame | None = None) -> DataFrame:
        """State of a table with its partition columns.

        ``where`` is a condition on partition columns and keys, ``only`` a frame
        of partitions, one row each. Both choose folders before the fold.
        """
        rows = self.stored(name)
        if where is not None:
            rows = rows.where(where)
        if only is not None:
            # at most a row for each partition of the table; read by the scan before it opens files
            rows = rows.join(F.broadcast(only), only.columns, "left_semi")
        found = self._fold(name, rows, places=False)
        return found.drop(*_OF_TEXT.names) if name == "analysis" else found

    def within(self, name: str, chat_id: int | None = None, start=None, end=None) -> Column:
        """Condition that chooses the folders of a chat and of days from ``start`` to ``end``."""
        parts = _TABLES[name][3]
        found = between_days(start, end) if DAY in parts else F.lit(True)
        if chat_id is not None:
            found = found & (F.col("chat_id") == chat_id)
            if BUCKET in parts:
                found = found & (F.col(BUCKET) == self.bucket_of(F.lit(chat_id)))
        return found

    def current(self, name: str, chat_id: int | None = None, start=None, end=None) -> DataFrame:
        """State of a table now, of one chat and of days from ``start`` to ``end`` if given.

        Other folders are not opened. Finer time bounds are the caller's.
        """
        return self.state(name, self.within(name, chat_id, start, end)).select(*S.names(_TABLES[name][0]))

    def merge(self, name: str, rows: DataFrame) -> None:
        """Upsert rows by appending them. Those of ``analysis`` need the ``day`` of their message,
        and its ``edit_date`` and ``redone`` where the analysis is that of the stored text.

        Without ``ingest_seq`` all rows count as arriving at once. The bytes
        written depend on ``rows`` alone.
        """
        _, _, _, parts = _TABLES[name]
        at = F.lit(time.time_ns() // 1000)
        seq = F.col(upsert.SEQ) if upsert.SEQ in rows.columns else F.lit(0)
        placed = rows.withColumns({FIRST[0]: at, FIRST[1]: seq, LAST[0]: at, LAST[1]: seq, FOLDED: F.lit(False)})
        if BUCKET in parts:
            placed = placed.withColumn(BUCKET, self.bucket_of(F.col("chat_id")))
        if name == "messages":
            placed = placed.withColumn(DAY, day_of("ts_utc"))
        if name == "edits":
            placed = placed.withColumn(EDIT_DAY, day_of("edit_date"))
        self._append(name, placed)

    def _append(self, name: str, rows: DataFrame) -> None:
        parts = _TABLES[name][3]
        whole = S.conform(rows, self._schema(name))
        # dealt by folder, a task has few of them: it keeps their files open and sorts only if they are more
        with setting(whole.sparkSession, OPEN_FILES, "16"):
            whole.hint("rebalance", *parts).write.mode("append").partitionBy(*parts).parquet(self.path(name))

    def settle(self, name: str, start=None, end=None) -> None:
        """Fold the partitions of closed days (of all, for tables without days) that got arrivals.

        The fold is added first and the files it was read from go afterwards,
        so neither readers nor a run after a crash miss a row; files that came
        in meanwhile stay. One job settles a table at a time.
        """
        parts = _TABLES[name][3]
        day = next((p for p in parts if p != BUCKET), None)
        # one listing: the fold and the list of files are of the same files
        held = self.stored(name)
        if not held.inputFiles():
            return
        if day is not None:
            held = held.where(between_days(start, end, day))
        listed = held.select(*parts, FOLDED, F.col("_metadata.file_path").alias("file")).distinct()
        scratch, files = written(listed, "files")
        open_parts = files.groupBy(*parts).agg(F.bool_and(FOLDED).alias("done")).where(~F.col("done")).drop("done")
        if not open_parts.isEmpty():
            rows = held.join(F.broadcast(open_parts), parts, "left_semi")
            self._append(name, self._fold(name, rows).withColumn(FOLDED, F.lit(True)))
            gone = files.join(open_parts, parts, "left_semi").select("file")
            delete(self.spark, (r.file for r in gone.toLocalIterator()))
        discard(self.spark, scratch)

    def snapshot(self, name: str, path: str) -> None:
        """Copy of the current state; an existing one is never overwritten."""
        self.current(name).write.mode("errorifexists").parquet(path)

    def set_aside(self, bad: DataFrame, batch_id: int, kind: str = "incomplete") -> None:
        """Rows that could not be ingested, with their reason; the same batch replaces its own."""
        bad.write.mode("overwrite").parquet(f"{self.path('quarantine')}/{kind}/batch_id={batch_id}")

    def quarantine(self, kind: str, schema: T.StructType) -> DataFrame:
        return self._read(f"{self.path('quarantine')}/{kind}", schema)

    def note(self, counts: DataFrame, run: str) -> None:
        """One row of counts for a run of the ingest; the same run replaces its own."""
        counts.write.mode("overwrite").parquet(f"{self.path('ingest_log')}/run={run}")

    def notes(self) -> DataFrame:
        return self._read(self.path("ingest_log"), S.INGEST_LOG)


def save_clustered(df: DataFrame, table: str, buckets: int) -> None:
    """Catalog table bucketed and sorted by the message key: two tables saved
    alike join on it without a shuffle."""
    (
        df.write.mode("errorifexists").format("parquet")
        .bucketBy(buckets, *S.KEY).sortBy(*S.KEY).saveAsTable(table)
    )

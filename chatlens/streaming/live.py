"""Live ingest as a Structured Streaming query.

Each micro-batch is normalised, merged into the messages, analysed, and followed
by its checkpoint rows. All of them are appended, so a batch writes as much as it
brings. Merging the same rows again changes nothing, so a batch that runs twice
after a failure leaves one result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatlens.functions.vocabulary import MODEL_VERSION
from chatlens.operators import analyse, upsert
from chatlens.sources import schemas as S
from chatlens.sources.session import discard, written
from chatlens.sources.tables import BUCKET, DAY, ChatTables, day_of
from chatlens.streaming.metrics import LiveMetrics

Prepare = Callable[[DataFrame], DataFrame]


def split_bad(lines: DataFrame, schema: T.StructType = S.RAW_MESSAGE, column: str = "value"
              ) -> tuple[DataFrame, DataFrame]:
    """JSON lines to (good rows, bad lines with a reason).

    A line that cannot be read, or lacks a required field, is set aside; the
    rest of its batch goes on.
    """
    corrupt = "_corrupt"
    wide = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields]
                        + [T.StructField(corrupt, T.StringType())])
    read = lines.withColumn(
        "_row", F.from_json(column, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    )
    reason = F.when(F.col("_row").isNull() | F.col(f"_row.{corrupt}").isNotNull(), F.lit("not readable"))
    for f in schema.fields:
        if not f.nullable:
            reason = reason.when(F.col(f"_row.{f.name}").isNull(), F.lit(f"no {f.name}"))
    judged = read.withColumn("reason", reason)
    good = judged.where(F.col("reason").isNull()).select(
        *[F.col(f"_row.{f.name}").alias(f.name) for f in schema.fields]
    )
    bad = judged.where(F.col("reason").isNotNull()).drop("_row")
    return good, bad


def missing_field() -> Column:
    """What a messages row lacks, or null; absent defaults are no fault."""
    reason = F.lit(None).cast("string")
    for f in S.MESSAGES.fields:
        if not f.nullable:
            reason = F.coalesce(reason, F.when(F.col(f.name).isNull(), F.lit(f"no {f.name}")))
    return reason


def split_incomplete(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages rows to (complete, incomplete with a reason)."""
    judged = rows.withColumn("reason", missing_field())
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def write_batch(tables: ChatTables, rows: DataFrame, batch_id: int | None, analyzed_at: Column,
                mode: str = analyse.STRICT) -> dict:
    """Messages, edits, analysis and checkpoints of one batch of messages rows; returns its counts.

    The rows are settled once and get the defaults of the table; incomplete
    ones are set aside and the others go on. Every arrival is analysed, and the
    last of each message counts, or that of the stored text if the tables are made so. Edits do not move the checkpoint, and no batch moves it back.
    Counts are observed on the writes themselves. ``batch_id`` names what is set
    aside and the counts; without one it is a re-scan.
    """
    seen, analysed = Observation(), Observation()
    judged = S.with_message_defaults(rows, analyzed_at).withColumn("reason", missing_field())
    good = F.col("reason").isNull()
    path, whole = written(judged.observe(
        seen, F.count(F.lit(1)).alias("rows_read"), F.count_if(~good).alias("rows_bad"),
        F.count_if(good & F.col("edit_date").isNotNull()).alias("edits"),
    ), "batch")
    counts = {"rows_analysed": 0, "rescan": batch_id is None, **seen.get}
    if batch_id is not None and counts["rows_bad"]:
        tables.set_aside(whole.where(~good), batch_id)
    if counts["rows_read"] > counts["rows_bad"]:
        complete = whole.where(good).drop("reason")
        tables.merge("messages", complete)
        if counts["edits"]:
            edited = complete.where(F.col("edit_date").isNotNull())
            tables.merge("edits", edited.withColumns({BUCKET: tables.bucket_of(F.col("chat_id")), DAY: day_of("ts_utc")}))
        # as it arrived, without a shuffle; the table's fold takes the one that counts
        texts = complete.drop(*[c for c in complete.columns if c not in (*S.KEY, "text", "ts_utc", "edit_date", upsert.SEQ)])
        done = analyse.annotate(texts.withColumn(DAY, day_of("ts_utc")), mode=mode).withColumns(
            {"model_version": F.lit(MODEL_VERSION), "analyzed_at": analyzed_at}
        )
        tables.merge("analysis", done.observe(analysed, F.count(F.lit(1)).alias("n")))
        counts["rows_analysed"] = analysed.get["n"]
        moved = complete.where(F.col("edit_date").isNull()).select("chat_id", "message_id", "ts_utc")
        tables.merge("ingest_checkpoint", upsert.checkpoints(moved, analyzed_at))
    row = tables.spark.createDataFrame([[counts[c] for c in S.names(S.INGEST_LOG)]], S.INGEST_LOG)
    tables.note(row, f"rescan-{uuid.uuid4().hex}" if batch_id is None else str(batch_id))
    discard(tables.spark, path)
    return counts


def settle_closed(tables: ChatTables, now: Column) -> None:
    """Settle the days before that of ``now``, and the small tables without days."""
    yesterday = F.date_sub(F.to_date(now), 1)
    for name in ("messages", "analysis", "edits"):
        tables.settle(name, end=yesterday)
    for name in ("ingest_checkpoint", "high_water_marks"):
        tables.settle(name)


def start_ingest(
    source: DataFrame, tables: ChatTables, checkpoint: str, prepare: Prepare,
    mode: str = analyse.STRICT, analyzed_at: Column | None = None, trigger: dict | None = None,
    name_bad: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None, settle_every: int | None = None,
    metrics: LiveMetrics | None = None, name: str = "ingest",
) -> StreamingQuery:
    """Start the ingest query.

    ``prepare`` turns source rows into messages rows with ``ingest_seq``.
    ``name_bad`` splits source rows that cannot even be read, such as broken
    JSON lines, from the others before that. With
    ``trigger={"availableNow": True}`` the query reads up to what is there at
    its start and ends: the bounded backfill. Started again on the same
    ``checkpoint`` with an interval it goes on live, without gap or repeat.
    After each ``settle_every`` batches the days before that of ``analyzed_at``
    are settled. ``metrics`` is told the counts of each batch, under ``name``.
    """

    stamp = F.current_timestamp() if analyzed_at is None else analyzed_at

    def each(batch: DataFrame, batch_id: int) -> None:
        if name_bad is not None:
            batch, unreadable = name_bad(batch)
            tables.set_aside(unreadable, batch_id, "unreadable")
        counts = write_batch(tables, prepare(batch), batch_id, stamp, mode)
        if metrics is not None:
            metrics.add(name, batch_id, counts)
        if settle_every and (batch_id + 1) % settle_every == 0:
            settle_closed(tables, stamp)

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if metrics is not None:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def backfill_then_live(
    source: DataFrame, tables: ChatTables, checkpoint: str, prepare: Prepare, marks: DataFrame,
    mode: str = analyse.STRICT, analyzed_at: Column | None = None, interval: dict | None = None,
) -> StreamingQuery:
    """Store the high-water marks, read what is there, then go on live.

    The bounded run ends before the live one starts on its checkpoint, so each
    source file is read once. Marks that are stored already stay.
    """
    tables.merge("high_water_marks", marks)
    start_ingest(source, tables, checkpoint, prepare, mode, analyzed_at, {"availableNow": True}).awaitTermination()
    return start_ingest(source, tables, checkpoint, prepare, mode, analyzed_at, interval)

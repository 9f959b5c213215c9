"""Streams run to their end; each must equal the batch result.

The stream's files are written from the given tables to the shared folder in
several parts, so that every query goes through several micro-batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue import report_queries as R
from catalogue import sql_text as Q
from catalogue import table_queries as T
from catalogue.registry import query
from chatlens.operators import analyse, normalise, upsert
from chatlens.plans import reports, rescan, stats
from chatlens.sources import csv_export, scans
from chatlens.sources import schemas as S
from chatlens.sources.session import scratch_folder
from chatlens.sources.tables import OF_STORED, ChatTables
from chatlens.streaming import dedupe, live, state

AT = "2024-02-01 00:00:00"
_NOW = {"availableNow": True}
_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
_STREAMED = S.T.StructType([*S.MESSAGES.fields, S.T.StructField(upsert.SEQ, S.T.LongType())])


def _parts(rows, column="ts_utc"):
    """Rows in three parts by time."""
    c = F.col(column)
    first, second = (I.at(t) for t in _CUTS)
    return [rows.where(c < first), rows.where((c >= first) & (c < second)), rows.where(c >= second)]


def _run(spark, folder, tables, checkpoint, schema, prepare, **more):
    live.start_ingest(
        scans.stream(spark, folder, schema), tables, checkpoint, prepare, analyse.LEXICON, I.at(AT), _NOW, **more
    ).awaitTermination()


def _same(rows):
    return rows


def _place(spark, **of_tables):
    return (
        scratch_folder(spark, "source"), scratch_folder(spark, "progress"),
        ChatTables(spark, scratch_folder(spark, "tables"), **of_tables),
    )


def _ingest(spark, parts, schema, prepare=_same, of_tables=None, **more):
    """Each part written to the source folder and read by a run of its own, which
    goes on where the one before it stopped."""
    folder, checkpoint, tables = _place(spark, **(of_tables or {}))
    for part in parts:
        part.write.mode("append").parquet(folder)
        _run(spark, folder, tables, checkpoint, schema, prepare, **more)
    return tables


def ingested(spark, sf):
    """All arrivals streamed into stored tables in three parts."""
    return _ingest(spark, _parts(S.conform(I.arrivals(spark, sf), _STREAMED)), _STREAMED)


_MERGED = f"WITH {I.MESSAGES_SQL}, {I.ARRIVALS_SQL}, {T._merge_sql(T._EDIT_RULE)}"


@query(_MERGED)
def stream_upsert(spark, sf):
    return T._table(ingested(spark, sf).current("messages"))


@query(_MERGED)
def stream_settled(spark, sf):
    """Days settled after every batch, then all arrivals once more on top of the settled ones."""
    arrivals = I.arrivals(spark, sf)
    tables = _ingest(spark, _parts(S.conform(arrivals, _STREAMED)), _STREAMED, settle_every=1)
    tables.merge("messages", arrivals)
    return T._table(tables.current("messages"))


@query(f"WITH {T._LAST_ANALYSIS} {T._ANALYSIS_ROWS}")
def stream_resume(spark, sf):
    """Stopped after each part and started again: analysis of last arrivals."""
    return T._analysis(ingested(spark, sf).current("analysis"))


_STORED_TEXTS = f"""{I.MESSAGES_SQL}, {I.ARRIVALS_SQL}, merged AS (WITH {T._merge_sql(T._EDIT_RULE)}),
{Q.annotated('a', 'merged', 'message_id')}"""


@query(f"WITH {_STORED_TEXTS} {T._ANALYSIS_ROWS}")
def stream_in_step(spark, sf):
    """Analysis of the texts that the messages hold, stale replays after edits and all."""
    parts = _parts(S.conform(I.arrivals(spark, sf), _STREAMED))
    tables = _ingest(spark, parts, _STREAMED, of_tables={"analysis_of": OF_STORED})
    return T._analysis(tables.current("analysis"))


@query(
    f"""WITH {I.MESSAGES_SQL} SELECT chat_id, max(message_id) AS last_message_id, arg_max(ts_utc, message_id) AS last_ts_utc
FROM messages WHERE edit_date IS NULL GROUP BY chat_id"""
)
def stream_checkpoint(spark, sf):
    """Checkpoints after the stream; edits never move them."""
    return ingested(spark, sf).current("ingest_checkpoint").select(
        "chat_id", "last_message_id", I.ntz("last_ts_utc").alias("last_ts_utc")
    )


@query(
    f"WITH {T._NORMALISED} SELECT chat_id, message_id, ts_utc, from_username, text, urls, edit_date FROM normalised"
)
def stream_normalise(spark, sf):
    """Raw source rows normalised inside the stream."""
    users, entities = I.users(spark, sf), I.entities(spark, sf)
    tables = _ingest(
        spark, _parts(S.conform(I.raw_messages(spark, sf), S.RAW_MESSAGE), "date"), S.RAW_MESSAGE,
        normalise.normaliser(users, entities),
    )
    return T._table(tables.current("messages"))


@query(
    f"""WITH {I.MESSAGES_SQL}, {I.ARRIVALS_SQL}, e AS (SELECT * FROM arrivals WHERE edit_date IS NOT NULL),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ingest_seq DESC) AS r FROM e) WHERE r = 1),
{Q.annotated('a', 'l', 'message_id')} {T._ANALYSIS_ROWS}"""
)
def stream_edits(spark, sf):
    """The stream of edits alone, re-analysed."""
    tables = _ingest(spark, _parts(S.conform(I.arrivals(spark, sf), _STREAMED)), _STREAMED, scans.edits)
    return T._analysis(tables.current("analysis"))


def _without_replays(spark, parts):
    """Parts streamed one after the other through the removal of replays."""
    state.use_disk_state(spark)
    folder, checkpoint = scratch_folder(spark, "source"), scratch_folder(spark, "progress")
    out = scratch_folder(spark, "deduped")

    def each(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for part in parts:
        part.write.mode("append").parquet(folder)
        kept = dedupe.drop_replays(scans.stream(spark, folder, _STREAMED))
        kept.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(
            **_NOW
        ).start().awaitTermination()
    return spark.read.schema(_STREAMED).parquet(out)


@query(f"WITH {I.MESSAGES_SQL} SELECT chat_id, message_id, edit_date, text FROM messages")
def stream_dedupe(spark, sf):
    """Every part holds each of its messages twice, and all come once more at the
    end; one of each survives."""
    rows = S.conform(I.messages(spark, sf), _STREAMED)
    kept = _without_replays(spark, [*[p.unionByName(p) for p in _parts(rows)], rows])
    return kept.select(*S.KEY, I.ntz("edit_date").alias("edit_date"), "text")


@query(
    f"""WITH {I.MESSAGES_SQL} SELECT chat_id, message_id, edit_date, text FROM messages
UNION ALL SELECT chat_id, message_id, TIMESTAMP '2024-02-01 00:00:00', 'late' FROM messages WHERE ts_utc < '{_CUTS[0]}'"""
)
def stream_late_edits(spark, sf):
    """Messages in the order newest part first, then edits of the oldest ones: late
    first deliveries and late edits all survive."""
    rows = S.conform(I.messages(spark, sf), _STREAMED)
    parts = _parts(rows)
    edits = parts[0].withColumns({"edit_date": I.at("2024-02-01 00:00:00"), "text": F.lit("late")})
    kept = _without_replays(spark, [parts[2], parts[1], parts[0], edits])
    return kept.select(*S.KEY, I.ntz("edit_date").alias("edit_date"), "text")


@query(_MERGED)
def stream_state(spark, sf):
    """The messages table kept as streaming state."""
    state.use_disk_state(spark)
    folder, checkpoint = scratch_folder(spark, "source"), scratch_folder(spark, "progress")
    out = scratch_folder(spark, "state")
    for part in _parts(S.conform(I.arrivals(spark, sf), _STREAMED)):
        part.write.mode("append").parquet(folder)
        source = scans.stream(spark, folder, _STREAMED)
        state.start_upsert_state(source, out, checkpoint, _NOW).awaitTermination()
    schema = S.T.StructType([*S.MESSAGES.fields, S.T.StructField("batch_id", S.T.LongType())])
    return T._table(state.current_state(spark.read.schema(schema).parquet(out)))


@query(_MERGED)
def stream_expiring_state(spark, sf):
    """The messages table as keyed state that forgets keys an hour after they changed."""
    state.use_disk_state(spark)
    folder, checkpoint = scratch_folder(spark, "source"), scratch_folder(spark, "progress")
    out = scratch_folder(spark, "state")
    for part in _parts(S.conform(I.arrivals(spark, sf), _STREAMED)):
        part.write.mode("append").parquet(folder)
        source = scans.stream(spark, folder, _STREAMED)
        state.start_expiring_state(source, out, checkpoint, 3_600_000, _NOW, slots=8).awaitTermination()
    return T._table(state.held_state(spark, checkpoint))


_LINES = S.T.StructType([S.T.StructField("line", S.T.LongType()), S.T.StructField("value", S.T.StringType())])


@query(
    """SELECT 'ingested' AS outcome, count(*) AS n FROM events WHERE event_type <> 'error' AND event_type <> 'click'
UNION ALL SELECT 'no text', count(*) FROM events WHERE event_type = 'click'
UNION ALL SELECT 'not readable', count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 0
UNION ALL SELECT 'no date', count(*) FROM events WHERE event_type = 'error' AND event_id % 2 = 1"""
)
def stream_quarantine(spark, sf):
    """JSON lines ingested live: broken lines and rows without text are set aside."""
    ev = I.table(spark, sf, "events").select(F.col("event_id").alias("line"), "event_type")
    lines = T._json_lines(spark, sf).join(ev, "line")
    users, entities = I.users(spark, sf), I.entities(spark, sf)
    normal = normalise.normaliser(users, entities)
    clicks = ev.where("event_type = 'click'").select((F.col("line") + 1).alias("message_id"))

    def prepare(rows):
        out = normal(rows.withColumn("id", F.col("id") + 1))
        no_text = F.col("_click").isNotNull()
        marked = out.join(clicks.withColumn("_click", F.lit(1)), "message_id", "left")
        return marked.withColumn("text", F.when(~no_text, F.col("text"))).drop("_click")

    tables = _ingest(spark, [lines.select("line", "value")], _LINES, prepare, name_bad=live.split_bad)
    reason = S.T.StructType([S.T.StructField("reason", S.T.StringType())])
    kinds = [tables.quarantine(kind, reason).select(F.col("reason").alias("outcome")) for kind in ("incomplete", "unreadable")]
    held = tables.current("messages").select(F.lit("ingested").alias("outcome"))
    return held.unionByName(kinds[0]).unionByName(kinds[1]).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    f"""WITH {I.MESSAGES_SQL}, mark AS (SELECT chat_id, max(message_id) AS mark FROM messages WHERE ts_utc < '{_CUTS[1]}' GROUP BY 1)
SELECT chat_id, mark, count(*) FILTER (ts_utc < '{_CUTS[1]}') AS before_start, count(*) FILTER (ts_utc >= '{_CUTS[1]}') AS after_start
FROM messages JOIN mark USING (chat_id) GROUP BY 1, 2"""
)
def backfill_then_live(spark, sf):
    """Marks stored, two parts read as the bounded backfill, the third one live on the same checkpoint."""
    folder, checkpoint, tables = _place(spark)
    parts = _parts(S.conform(I.messages(spark, sf), _STREAMED))
    old = parts[0].unionByName(parts[1])
    old.write.mode("append").parquet(folder)
    marks = upsert.high_water_marks(old, old.select("chat_id").distinct(), I.at(AT))
    running = live.backfill_then_live(
        scans.stream(spark, folder, _STREAMED), tables, checkpoint, _same, marks, analyse.LEXICON, I.at(AT),
        {"processingTime": "0 seconds"},
    )
    try:
        parts[2].write.mode("append").parquet(folder)
        running.processAllAvailable()
    finally:
        running.stop()
    cut = I.at(_CUTS[1])
    return tables.current("messages").join(
        tables.current("high_water_marks").select("chat_id", F.col("message_id").alias("mark")), "chat_id"
    ).groupBy("chat_id", "mark").agg(
        F.count_if(F.col("ts_utc") < cut).alias("before_start"), F.count_if(F.col("ts_utc") >= cut).alias("after_start")
    )


_SPAN = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query(
    f"""WITH {I.MESSAGES_SQL}, {I.ARRIVALS_SQL}, w AS (SELECT * FROM arrivals WHERE ts_utc BETWEEN '{_SPAN[0]}' AND '{_SPAN[1]}')
SELECT (SELECT count(*) FROM arrivals) + (SELECT count(*) FROM w) AS rows_read, 0::BIGINT AS rows_bad,
  (SELECT count(*) FROM messages) AS messages_ingested, (SELECT count(*) FROM messages) AS messages_analysed, 1::BIGINT AS rescans,
  greatest(0.0, (epoch_us(TIMESTAMP '{AT}') - epoch_us((SELECT min(t) FROM (SELECT arg_max(ts_utc, message_id) AS t
    FROM messages WHERE edit_date IS NULL GROUP BY chat_id)))) / 1e6) AS lag_seconds"""
)
def ingest_stats(spark, sf):
    """Counts of a streamed ingest and one re-scan, as stored."""
    tables = ingested(spark, sf)
    rescan.rescan_tables(tables, I.arrivals(spark, sf), *[I.at(t) for t in _SPAN], I.at(AT), analyse.LEXICON)
    return stats.ingest_stats(tables, I.at(AT))


def _ingested_messages(spark, sf):
    return _ingest(spark, _parts(S.conform(I.messages(spark, sf), _STREAMED)), _STREAMED)


@query(
    f"""WITH {R.FRAME}, picked AS (SELECT * FROM frame WHERE contains(lower(topic_key), 'sol') OR list_contains(tokens, 'SOL')
  ORDER BY ts_utc DESC, message_id DESC LIMIT 40), {R._report_sql('picked')}"""
)
def stored_report(spark, sf):
    """Standard report with topic and limit over streamed tables."""
    return reports.standard_report(_ingested_messages(spark, sf), R.CHAT, I.at(R.START), I.at(R.END), "sol", 40)


@query(f"SELECT * EXCLUDE (chat_id) FROM (WITH {R._POINTS}, {R._FLAT.format(by='chat_id,', using='chat_id, token')}) WHERE chat_id = {R.CHAT}")
def stored_token_report(spark, sf):
    """Token report of a whole chat over streamed tables."""
    rows = reports.tokens_report(
        _ingested_messages(spark, sf), R.CHAT, I.at("2000-01-01 00:00:00"), I.at("2100-01-01 00:00:00")
    )
    return rows.withColumns({c: F.array_join(c, "|") for c in ("bullish_points", "bearish_points")})


def _ingested_texts(spark, sf):
    """Whole documents and whole turns, a chat each, streamed into stored tables in two parts."""
    numbered = lambda rows: rows.where(F.col("text").isNotNull()).withColumn("is_forwarded", F.lit(False))
    turns = F.col("chat_id") * 1000 + F.col("message_id")
    documents = numbered(R._as_chats(I.prose(spark, sf), F.col("doc_id")))
    talks = numbered(R._as_chats(I.conversation_messages(spark, sf), turns)).withColumn("chat_id", F.lit(R.CHAT + 1).cast("long"))
    sent = [rows.withColumn(upsert.SEQ, F.col("message_id")) for rows in (documents, talks)]
    return _ingest(spark, [S.conform(rows, _STREAMED) for rows in sent], _STREAMED)


_TEXT_SPAN = (R._TEXT_START, "9000-01-01 00:00:00")
_DOCUMENTS = "SELECT doc_id AS message_id, text FROM prose WHERE text IS NOT NULL"


@query(f"WITH {I.PROSE_SQL}, {R._text_report_sql(_DOCUMENTS)}")
def stored_documents(spark, sf):
    """Standard report over streamed tables that hold whole documents beside another chat."""
    return reports.standard_report(_ingested_texts(spark, sf), R.CHAT, *[I.at(t) for t in _TEXT_SPAN])


@query(
    f"WITH {R._text_report_sql('SELECT conv_id * 1000 + turn AS message_id, text FROM conversations WHERE text IS NOT NULL')}"
)
def stored_conversations(spark, sf):
    """The same of whole turns."""
    return reports.standard_report(_ingested_texts(spark, sf), R.CHAT + 1, *[I.at(t) for t in _TEXT_SPAN])


@query(R._EXPORT)
def stored_export(spark, sf):
    """CSV export over streamed tables, read back."""
    path = scratch_folder(spark, "export")
    reports.export(_ingested_messages(spark, sf), R.CHAT, I.at(R.START), I.at(R.END), path)
    return csv_export.read_csv(spark, path)

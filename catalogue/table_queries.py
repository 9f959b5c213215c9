"""Queries over scans, normalisation, upserts, table contracts and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue import sql_text as Q
from catalogue.registry import query
from catalogue.report_queries import WHOLE, stored_analysis
from catalogue.text_queries import joined
from chatlens.functions import vocabulary as V
from chatlens.operators import analyse, normalise, quality, relational, upsert
from chatlens.plans import backfill, rescan
from chatlens.sources import codecs, scans
from chatlens.sources import schemas as S
from chatlens.sources.session import scratch_folder
from chatlens.sources.tables import ChatTables
from chatlens.streaming import live

M, A, R = I.MESSAGES_SQL, I.ARRIVALS_SQL, I.RAW_SQL
_NL = "chr(10)"


def _author_sql(text: str) -> str:
    """CTE body: author and rest of a text, line by line."""
    first = f"trim(string_split({Q.strip(text)}, {_NL})[1])"
    stops = " OR ".join(f"contains(lower({first}), {Q.lit(s)})" for s in V.AUTHOR_LINE_STOPS)
    ok = (
        f"len(string_split({Q.strip(text)}, {_NL})) > 1 AND length({first}) <= 50 AND NOT ({stops}) "
        rf"AND len(string_split_regex({first}, '\s+')) <= 3"
    )
    rest = f"array_to_string(string_split({Q.strip(text)}, {_NL})[2:], {_NL})"
    return f"CASE WHEN {ok} THEN {first} END AS author, CASE WHEN {ok} THEN {Q.strip(rest)} ELSE {text} END AS body"


@query(f"SELECT conv_id, turn, {_author_sql('text')} FROM conversations")
def normalise_first_line_author(spark, sf):
    """Whole conversations; most turns have several lines."""
    return I.table(spark, sf, "conversations").select(
        "conv_id", "turn", normalise.author_split(F.col("text")).alias("s")
    ).select("conv_id", "turn", F.col("s.author").alias("author"), F.col("s.text").alias("body"))


@query(f"WITH {R} SELECT chat_id, id, urls FROM raw WHERE message <> ''")
def normalise_urls(spark, sf):
    return normalise.with_text(I.raw_messages(spark, sf)).select(
        "chat_id", "id", F.array_join(normalise.urls(F.col("entities")), " ").alias("urls")
    )


@query(
    f"""WITH {R} SELECT chat_id, id, u.username AS handle FROM raw
LEFT JOIN users u ON u.user_id = sender_id AND kind = 'user'"""
)
def normalise_sender(spark, sf):
    return normalise.with_sender(I.raw_messages(spark, sf), I.users(spark, sf)).select(
        "chat_id", "id", "handle"
    )


_FORWARD = """CASE WHEN from_name IS NOT NULL THEN from_name WHEN from_id IS NULL THEN NULL
  WHEN e.entity_id IS NULL THEN from_id::VARCHAR ELSE coalesce(e.title, e.username) END AS forward_from"""


@query(
    f"WITH {R} SELECT chat_id, id, is_forwarded, {_FORWARD} FROM raw LEFT JOIN entities e ON e.entity_id = from_id"
)
def normalise_forward(spark, sf):
    return normalise.with_forward(I.raw_messages(spark, sf), I.entities(spark, sf)).select(
        "chat_id", "id", "is_forwarded", "forward_from"
    )


_NORMALISED = f"""{R}, split AS (SELECT *, {_author_sql('message')} FROM raw WHERE message <> ''),
normalised AS (SELECT chat_id, id AS message_id, date AS ts_utc, sender_id AS from_user_id,
  coalesce(nullif(author, ''), u.username) AS from_username, is_forwarded, {_FORWARD}, body AS text, urls,
  reply_to_id, edit_date FROM split LEFT JOIN users u ON u.user_id = sender_id AND kind = 'user'
  LEFT JOIN entities e ON e.entity_id = from_id)"""


def _shown(rows):
    return rows.select(
        *S.KEY, I.ntz("ts_utc").alias("ts_utc"), "from_user_id", "from_username", "is_forwarded", "forward_from",
        "text", F.array_join("urls", " ").alias("urls"), "reply_to_id", I.ntz("edit_date").alias("edit_date"),
    )


@query(f"WITH {_NORMALISED} SELECT * FROM normalised")
def normalise_all(spark, sf):
    return _shown(
        normalise.normalise(I.raw_messages(spark, sf), I.users(spark, sf), I.entities(spark, sf))
    )


def _merge_sql(rule: str, source: str = "arrivals") -> str:
    """Row-by-row order of arrivals turned into window ranks."""
    return f"""first AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ingest_seq) AS r FROM {source}),
edit AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY {rule}) AS r FROM {source})
SELECT f.chat_id, f.message_id, f.ts_utc, f.from_username, e.text, e.urls, e.edit_date
FROM first f JOIN edit e USING (chat_id, message_id) WHERE f.r = 1 AND e.r = 1"""


_EDIT_RULE = """(edit_date IS NOT NULL) DESC, edit_date DESC,
  CASE WHEN edit_date IS NULL THEN -ingest_seq ELSE ingest_seq END"""


def _table(rows):
    return rows.select(
        *S.KEY, I.ntz("ts_utc").alias("ts_utc"), "from_username", "text",
        F.array_join("urls", " ").alias("urls"), I.ntz("edit_date").alias("edit_date"),
    )


@query(f"WITH {M}, {A}, {_merge_sql(_EDIT_RULE)}")
def upsert_messages(spark, sf):
    return _table(upsert.fold_messages(I.arrivals(spark, sf)))


@query(
    f"""WITH {M}, {A}, l AS (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ingest_seq DESC) AS r FROM arrivals)
SELECT chat_id, message_id, ts_utc, from_username, text, urls, edit_date FROM l WHERE r = 1"""
)
def replace_messages(spark, sf):
    return _table(upsert.fold_latest(I.arrivals(spark, sf)))


@query(f"WITH {M}, {A}, {_merge_sql(_EDIT_RULE)}")
def merge_replay(spark, sf):
    """The table merged with all its arrivals once more: nothing may change."""
    arrivals = I.arrivals(spark, sf)
    return _table(upsert.merge_messages(upsert.fold_messages(arrivals), arrivals))


_LAST_ANALYSIS = f"""{M}, {A}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id
  ORDER BY ingest_seq DESC) AS r FROM arrivals) WHERE r = 1),
{Q.annotated('a', 'l', 'message_id')}"""
_S, _C = Q.lexicon_verdict()
_ANALYSIS_ROWS = f"""SELECT chat_id, message_id, is_investment, {_S} AS sentiment, {_C} AS confidence,
  array_to_string(tokens, '|') AS tokens, topic_key FROM a"""


def _analysis(rows):
    return rows.select(
        *S.KEY, "is_investment", "sentiment", "confidence", joined("tokens").alias("tokens"), "topic_key"
    )


@query(f"WITH {_LAST_ANALYSIS} {_ANALYSIS_ROWS}")
def upsert_analysis(spark, sf):
    """Every arrival analysed, the last one kept."""
    arrivals = I.arrivals(spark, sf)
    rows = analyse.annotate(arrivals.select(*S.KEY, "text", upsert.SEQ), mode=analyse.LEXICON)
    return _analysis(upsert.fold_latest(rows.drop("text", "key_points")))


@query(
    f"""WITH {M}, {A} SELECT chat_id, max(message_id) AS last_message_id,
  arg_max(ts_utc, message_id) AS last_ts_utc FROM arrivals GROUP BY chat_id"""
)
def checkpoint_put(spark, sf):
    """Checkpoints after every day's batch, the last write of each chat kept."""
    daily = I.arrivals(spark, sf).groupBy("chat_id", F.to_date("ts_utc").alias("day")).agg(
        F.max(F.struct("message_id", "ts_utc")).alias("m")
    )
    writes = daily.select(
        "chat_id", F.col("m.message_id").alias("last_message_id"), F.col("m.ts_utc").alias("last_ts_utc"),
        F.unix_date("day").cast("long").alias(upsert.SEQ),
    )
    return upsert.fold_latest(writes, ["chat_id"]).withColumn("last_ts_utc", I.ntz("last_ts_utc"))


_MARKS = f"""marks AS (SELECT c.chat_id, coalesce(max(message_id), 0) AS message_id,
  coalesce(arg_max(ts_utc, message_id), TIMESTAMP '{I.NOW}') AS ts_utc
  FROM (SELECT DISTINCT n_nationkey::BIGINT AS chat_id FROM nation) c LEFT JOIN messages m USING (chat_id) GROUP BY c.chat_id)"""


def _marks(spark, sf):
    chats = I.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("chat_id"))
    return upsert.high_water_marks(I.messages(spark, sf), chats, I.at(I.NOW))


@query(f"WITH {M}, {_MARKS} SELECT * FROM marks")
def high_water_mark(spark, sf):
    """Marks of listed chats, most of which are empty."""
    return _marks(spark, sf).drop("created_at").withColumn("ts_utc", I.ntz("ts_utc"))


_SCAN = "SELECT chat_id, message_id, text FROM messages"


@query(f"WITH {M} {_SCAN} WHERE message_id > 100 AND message_id <= 700 ORDER BY message_id LIMIT 500")
def scan_id_range(spark, sf):
    return scans.by_id(I.messages(spark, sf), 100, 700, 500).select(*S.KEY, "text")


@query(f"WITH {M} {_SCAN} WHERE ts_utc BETWEEN '2024-01-02 06:00:00' AND '2024-01-20 18:00:00'")
def scan_time_range(spark, sf):
    rows = scans.by_time(I.messages(spark, sf), I.at("2024-01-02 06:00:00"), I.at("2024-01-20 18:00:00"))
    return rows.select(*S.KEY, "text")


@query(f"WITH {M} {_SCAN} WHERE (chat_id, message_id) IN (SELECT c_custkey % 3 + 1, c_custkey + 1 FROM customer)")
def lookup_ids(spark, sf):
    key = F.col("c_custkey")
    wanted = I.table(spark, sf, "customer").select(
        (key % 3 + 1).alias("chat_id"), (key + 1).alias("message_id")
    )
    return scans.by_ids(I.messages(spark, sf), wanted).select(*S.KEY, "text")


@query(
    f"""WITH {M}, {A}, m AS (SELECT *, CASE WHEN contains(text, 'gm') THEN NULL ELSE text END AS t FROM arrivals),
a AS (SELECT chat_id, CASE WHEN event_type = 'purchase' THEN message_id + 10000000 ELSE message_id END AS message_id,
  CASE WHEN value > 50 THEN 'UNSURE' ELSE 'NEUTRAL' END AS sentiment, CASE WHEN user_id % 5 > 0 THEN 'X' END AS topic_key
  FROM (SELECT user_id % 3 + 1 AS chat_id, event_id + 1 AS message_id, * FROM events))
SELECT 'messages_not_null' AS "check", count(*) FILTER (t IS NULL) AS violations FROM m
UNION ALL SELECT 'messages_primary_key', count(*) FROM (SELECT 1 FROM m GROUP BY chat_id, message_id HAVING count(*) > 1)
UNION ALL SELECT 'analysis_not_null', count(*) FILTER (topic_key IS NULL) FROM a
UNION ALL SELECT 'analysis_primary_key', count(*) FROM (SELECT 1 FROM a GROUP BY chat_id, message_id HAVING count(*) > 1)
UNION ALL SELECT 'analysis_sentiment', count(*) FILTER (sentiment NOT IN ('BULLISH', 'BEARISH', 'NEUTRAL')) FROM a
UNION ALL SELECT 'analysis_reference', count(*) FROM a WHERE NOT EXISTS
  (SELECT 1 FROM m WHERE m.chat_id = a.chat_id AND m.message_id = a.message_id)"""
)
def constraint_report(spark, sf):
    messages = I.arrivals(spark, sf).withColumn(
        "text", F.when(~F.contains("text", F.lit("gm")), F.col("text"))
    )
    ev = I.table(spark, sf, "events")
    analysis = ev.select(
        (F.col("user_id") % 3 + 1).alias("chat_id"),
        (F.col("event_id") + 1 + F.when(F.col("event_type") == "purchase", 10_000_000).otherwise(0)).alias("message_id"),
        F.lit(True).alias("is_investment"),
        F.when(F.col("value") > 50, "UNSURE").otherwise("NEUTRAL").alias("sentiment"),
        F.when(F.col("user_id") % 5 > 0, "X").alias("topic_key"),
    )
    return quality.constraint_report(messages, S.conform(analysis, S.ANALYSIS))


@query(
    f"""SELECT event_id, event_type = 'view' AND value > 10 AS is_forwarded, TIMESTAMP '{I.NOW}' AS created_at,
  CASE WHEN user_id % 4 = 0 THEN 1 ELSE 2 END::INTEGER AS model_version,
  CASE WHEN event_type = 'click' THEN TIMESTAMP '{I.NOW}' ELSE ts END AS analyzed_at FROM events"""
)
def defaults(spark, sf):
    rows = I.table(spark, sf, "events").select(
        "event_id",
        F.when((F.col("event_type") == "view") & (F.col("value") > 10), True).alias("is_forwarded"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.when(F.col("user_id") % 4 != 0, 2).alias("model_version"),
        F.when(F.col("event_type") != "click", F.col("ts").cast("timestamp")).alias("analyzed_at"),
    )
    now = I.at(I.NOW)
    full = S.with_analysis_defaults(S.with_message_defaults(rows, now), now)
    return full.withColumns({c: I.ntz(c) for c in ("created_at", "analyzed_at")})


@query("SELECT event_id, epoch_us(ts) AS micros FROM events")
def retype_utc(spark, sf):
    """Zone-less times to instants, shown as microseconds since 1970 in UTC."""
    return I.table(spark, sf, "events").select(
        "event_id", F.unix_micros(normalise.stamp_utc(F.col("ts"))).alias("micros")
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN '' WHEN 'error' THEN ''
  ELSE event_type || '|' || user_id || '|a"b' END AS items,
  CASE event_type WHEN 'click' THEN '[]' ELSE '["' || event_type || '","' || user_id || '","a\\"b"]' END AS as_json FROM events"""
)
def json_arrays(spark, sf):
    """Arrays to JSON text and back; texts of failed events are cut short."""
    items = F.when(F.col("event_type") == "click", F.array().cast("array<string>")).otherwise(
        F.array("event_type", F.col("user_id").cast("string"), F.lit('a"b'))
    )
    text = codecs.array_to_json(items)
    stored = F.when(F.col("event_type") == "error", F.substring(text, 1, 5)).otherwise(text)
    return I.table(spark, sf, "events").select(
        "event_id", joined(codecs.json_to_array(stored)).alias("items"), text.alias("as_json")
    )


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN date_trunc('second', ts) ELSE ts END AS back,
  CASE WHEN event_type = 'view' OR microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS iso FROM events"""
)
def iso_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    iso = codecs.time_to_iso(
        F.when(F.col("event_type") == "view", F.date_trunc("second", ts)).otherwise(ts)
    )
    stored = F.when(F.col("event_type") == "error", F.concat(F.lit("x"), iso)).otherwise(iso)
    return I.table(spark, sf, "events").select(
        "event_id", I.ntz(codecs.iso_to_time(stored)).alias("back"), iso.alias("iso")
    )


@query(f"WITH {M}, {A}, {_merge_sql(_EDIT_RULE)}")
def snapshot_roundtrip(spark, sf):
    """Two batches merged, one of them twice, copied, read back."""
    arrivals = I.arrivals(spark, sf)
    tables = ChatTables(spark, scratch_folder(spark, "tables"))
    early = F.col("ts_utc") < I.at("2024-01-15 00:00:00")
    tables.merge("messages", arrivals.where(early & F.col("edit_date").isNull()))
    rest = arrivals.where(~(early & F.col("edit_date").isNull()))
    tables.merge("messages", rest)
    tables.merge("messages", rest)
    copy = scratch_folder(spark, "snapshot")
    tables.snapshot("messages", copy)
    return _table(spark.read.schema(S.MESSAGES).parquet(copy))


@query(
    f"""WITH {M} SELECT chat_id, message_id, edit_date FROM messages WHERE edit_date IS NOT NULL
AND (reply_to_id IS NOT NULL OR edit_date > ts_utc + to_hours(((message_id - 1) % 7)::INTEGER))"""
)
def needs_reanalysis(spark, sf):
    messages = I.messages(spark, sf)
    hours = F.make_dt_interval(F.lit(0), ((F.col("message_id") - 1) % 7).cast("int"), F.lit(0), F.lit(0.0))
    analysis = messages.where(F.col("reply_to_id").isNull()).select(
        *S.KEY, (F.col("ts_utc") + hours).alias("analyzed_at")
    )
    return relational.needs_reanalysis(messages, analysis).withColumn("edit_date", I.ntz("edit_date"))


_DONE = "checkpoints AS (SELECT chat_id, max(message_id) AS last_id FROM messages WHERE ts_utc < '2024-01-20' AND chat_id < 3 GROUP BY 1)"


def _checkpoints(spark, sf):
    done = I.messages(spark, sf).where((F.col("ts_utc") < I.at("2024-01-20 00:00:00")) & (F.col("chat_id") < 3))
    return upsert.checkpoints(done, I.at(I.NOW))


@query(
    f"""WITH {M}, {_MARKS}, {_DONE} SELECT m.chat_id, m.message_id FROM messages m JOIN marks h USING (chat_id)
LEFT JOIN checkpoints c USING (chat_id) WHERE m.message_id > coalesce(c.last_id, 0) AND m.message_id <= h.message_id"""
)
def backfill_pending(spark, sf):
    rows = backfill.pending(I.messages(spark, sf), _marks(spark, sf), _checkpoints(spark, sf))
    return rows.select(*S.KEY)


@query(
    f"""WITH {M}, {_MARKS}, {_DONE}, b AS (SELECT chat_id, coalesce(last_id, 0) + 1 AS first_id, h.message_id AS last_id
  FROM marks h LEFT JOIN checkpoints USING (chat_id)),
r AS (SELECT chat_id, last_id, unnest(generate_series(first_id, last_id, 100)) AS from_id FROM b WHERE first_id <= last_id)
SELECT chat_id, from_id, least(from_id + 99, last_id) AS to_id FROM r"""
)
def backfill_plan(spark, sf):
    return backfill.plan(backfill.bounds(_marks(spark, sf), _checkpoints(spark, sf)))


@query(
    f"""WITH {M} SELECT chat_id, max(message_id) AS last_message_id, arg_max(ts_utc, message_id) AS last_ts_utc
FROM messages WHERE from_username IS NOT NULL GROUP BY chat_id"""
)
def advance_checkpoint(spark, sf):
    """Checkpoints over the rows that succeeded; here those with an author."""
    good = I.messages(spark, sf).where(F.col("from_username").isNotNull())
    return upsert.checkpoints(good, I.at(I.NOW)).drop("updated_at").withColumn(
        "last_ts_utc", I.ntz("last_ts_utc")
    )


def _early(df):
    return df.where(F.col(upsert.SEQ) < 3_000_000_000_000)


_WINDOW = "ts_utc BETWEEN '2024-01-10 00:00:00' AND '2024-01-20 00:00:00'"


@query(
    f"""WITH {M}, {A}, seen AS (SELECT * FROM arrivals WHERE ingest_seq < 3000000000000 OR {_WINDOW}),
{_merge_sql(_EDIT_RULE, 'seen')}"""
)
def rescan_messages(spark, sf):
    """First arrivals stored, then ten days of the source read again."""
    arrivals = I.arrivals(spark, sf)
    messages, _ = rescan.rescan_range(
        upsert.fold_messages(_early(arrivals)), stored_analysis(spark, sf), arrivals,
        I.at("2024-01-10 00:00:00"), I.at("2024-01-20 00:00:00"), I.at(I.NOW),
    )
    return _table(messages)


@query(
    f"""WITH {WHOLE}, {A}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id
  ORDER BY ingest_seq DESC) AS r FROM arrivals WHERE {_WINDOW}) WHERE r = 1),
{Q.annotated('a', 'l', 'message_id')}, fresh AS ({_ANALYSIS_ROWS}),
old AS (SELECT chat_id, message_id, is_investment, sentiment, confidence, array_to_string(tokens, '|') AS tokens, topic_key
  FROM analysed)
SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE (chat_id, message_id) NOT IN (SELECT chat_id, message_id FROM fresh)"""
)
def rescan_analysis(spark, sf):
    arrivals = I.arrivals(spark, sf)
    _, analysis = rescan.rescan_range(
        upsert.fold_messages(_early(arrivals)), stored_analysis(spark, sf), arrivals,
        I.at("2024-01-10 00:00:00"), I.at("2024-01-20 00:00:00"), I.at(I.NOW), analyse.LEXICON,
    )
    return _analysis(analysis)


@query(
    f"""WITH {M}, {A}, seen AS (SELECT * FROM arrivals WHERE ingest_seq < 3000000000000 OR {_WINDOW}),
{_merge_sql(_EDIT_RULE, 'seen')}"""
)
def rescan_tables(spark, sf):
    """The same re-reading done on stored tables."""
    arrivals = I.arrivals(spark, sf)
    tables = ChatTables(spark, scratch_folder(spark, "tables"))
    live.write_batch(tables, _early(arrivals), 0, I.at(I.NOW))
    rescan.rescan_tables(
        tables, arrivals, I.at("2024-01-10 00:00:00"), I.at("2024-01-20 00:00:00"), I.at("2024-02-01 00:00:00")
    )
    return _table(tables.current("messages"))


@query(
    f"""SELECT chat_id, message_id, CASE WHEN {_WINDOW} THEN TIMESTAMP '2024-03-05 00:00:00'
  WHEN edit_date IS NOT NULL AND edit_date >= '2024-01-10 00:00:00' THEN TIMESTAMP '2024-03-01 00:00:00'
  ELSE TIMESTAMP '2024-01-01 00:00:00' END AS analyzed_at FROM (WITH {M}, {A}, {_merge_sql(_EDIT_RULE)})"""
)
def rescan_twice(spark, sf):
    """Ten days read again twice: the analysis is that of the second time. Edits made
    since then are done anew once, wherever their message lies."""
    arrivals = I.arrivals(spark, sf)
    tables = ChatTables(spark, scratch_folder(spark, "tables"))
    live.write_batch(tables, arrivals, 0, I.at("2024-01-01 00:00:00"))
    for day in ("2024-03-01", "2024-03-05"):
        rescan.rescan_tables(
            tables, arrivals, I.at("2024-01-10 00:00:00"), I.at("2024-01-20 00:00:00"), I.at(f"{day} 00:00:00"),
            edited_since=I.at("2024-01-10 00:00:00"),
        )
    return tables.current("analysis").select(*S.KEY, I.ntz("analyzed_at").alias("analyzed_at"))


@query(
    f"""WITH {M}, {A} SELECT chat_id, message_id, edit_date FROM arrivals
WHERE ts_utc BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 120 MINUTE AND TIMESTAMP '2024-01-20 00:00:00'"""
)
def overlap_window(spark, sf):
    rows = rescan.overlap_window(I.arrivals(spark, sf), I.at("2024-01-20 00:00:00"))
    return rows.select(*S.KEY, I.ntz("edit_date").alias("edit_date"))


@query(
    f"""WITH {M} SELECT chat_id, message_id, CASE WHEN edit_date >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 600 MINUTE
  OR ts_utc BETWEEN TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 600 MINUTE AND TIMESTAMP '2024-01-20 00:00:00'
  THEN TIMESTAMP '2024-03-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' END AS analyzed_at FROM messages"""
)
def overlap_rescan(spark, sf):
    """The overlap step on stored tables: the last hours read again, edits since then re-analysed."""
    rows = I.messages(spark, sf)
    tables = ChatTables(spark, scratch_folder(spark, "tables"))
    live.write_batch(tables, rows, 0, I.at("2024-01-01 00:00:00"))
    rescan.overlap_rescan(tables, rows, I.at("2024-01-20 00:00:00"), I.at("2024-03-01 00:00:00"), minutes=600)
    return tables.current("analysis").select(*S.KEY, I.ntz("analyzed_at").alias("analyzed_at"))


@query(
    f"""WITH {WHOLE}, done AS (SELECT *, CASE WHEN edit_date IS NOT NULL THEN TIMESTAMP '2024-02-02 00:00:00'
  ELSE TIMESTAMP '2024-01-01 00:00:00' END AS analyzed_at FROM analysed)
SELECT chat_id, message_id, is_investment, sentiment, confidence, array_to_string(tokens, '|') AS tokens, topic_key, analyzed_at FROM done"""
)
def reanalyse_edited(spark, sf):
    """An early analysis brought up to date: every edited message is done anew."""
    early = stored_analysis(spark, sf).withColumn("analyzed_at", I.at("2024-01-01 00:00:00"))
    done = rescan.reanalyse_edited(
        I.messages(spark, sf), early, I.at("2024-02-02 00:00:00"), analyse.LEXICON
    )
    return _analysis(done).join(
        done.select(*S.KEY, I.ntz("analyzed_at").alias("analyzed_at")), S.KEY
    )


def _json_lines(spark, sf):
    """Raw messages as JSON lines; those of failed events lack parts or are cut."""
    raw = I.raw_messages(spark, sf).withColumn("message", F.coalesce(F.nullif("message", F.lit("")), F.lit("-")))
    ev = I.table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    line = F.to_json(F.struct(*[c for c in raw.columns]))
    no_date = F.to_json(F.struct("chat_id", "id", "message"))
    value = (
        F.when(F.col("event_type") != "error", line)
        .when(F.col("id") % 2 == 0, F.substring(line, 1, 25))
        .otherwise(no_date)
    )
    return raw.join(ev, "id").select(F.col("id").alias("line"), value.alias("value"))


@query(
    """SELECT event_id AS line, CASE WHEN event_type <> 'error' THEN 'good'
  WHEN event_id % 2 = 0 THEN 'not readable' ELSE 'no date' END AS outcome FROM events"""
)
def quarantine(spark, sf):
    good, bad = live.split_bad(_json_lines(spark, sf))
    return good.select(F.col("id").alias("line"), F.lit("good").alias("outcome")).unionByName(
        bad.select("line", F.col("reason").alias("outcome"))
    )

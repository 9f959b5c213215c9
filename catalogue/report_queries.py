"""Queries over reports and report requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue import sql_text as Q
from catalogue.registry import query
from catalogue.text_queries import joined
from chatlens.functions import ranges
from chatlens.functions import vocabulary as V
from chatlens.operators import analyse, relational, report, requests, token_report
from chatlens.sources import csv_export
from chatlens.sources import schemas as S
from chatlens.sources.session import scratch_folder, settled

M = I.MESSAGES_SQL
CHAT, START, END = 2, "2024-01-03 00:00:00", "2024-01-24 23:59:59"


def stored_analysis(spark, sf, replies=True):
    """Analysis table of all messages, or one that lacks the replies."""
    rows = I.messages(spark, sf)
    if not replies:
        rows = rows.where(F.col("reply_to_id").isNull())
    return analyse.analyse(rows, I.at(I.ANALYSED_AT), mode=analyse.LEXICON)


def whole_frame(spark, sf):
    """All messages with their analysis."""
    return relational.report_columns(
        relational.with_analysis(I.messages(spark, sf), stored_analysis(spark, sf))
    )


def report_frame(spark, sf, topic=None, limit=None, replies=True):
    return relational.report_frame(
        I.messages(spark, sf), stored_analysis(spark, sf, replies), CHAT, I.at(START), I.at(END), topic, limit
    )


def parsed_requests(spark, sf):
    return settled(requests.parse(I.requests(spark, sf)), "requests")


WHOLE = f"""{M}, {Q.analysed_ctes()},
whole AS (SELECT chat_id, message_id, ts_utc, from_username, text, is_investment, sentiment, tokens, key_points, topic_key
  FROM analysed)"""
# Where replies were never analysed.
_PART = f"""{M}, {Q.analysed_ctes()},
whole AS (SELECT chat_id, message_id, ts_utc, from_username, text,
  reply_to_id IS NULL AND is_investment AS is_investment,
  CASE WHEN reply_to_id IS NULL THEN sentiment END AS sentiment,
  CASE WHEN reply_to_id IS NULL THEN tokens ELSE [] END AS tokens,
  CASE WHEN reply_to_id IS NULL THEN key_points ELSE [] END AS key_points,
  CASE WHEN reply_to_id IS NULL THEN topic_key END AS topic_key FROM analysed)"""
IN_REPORT = f"chat_id = {CHAT} AND ts_utc BETWEEN '{START}' AND '{END}'"
FRAME = f"{WHOLE}, frame AS (SELECT * FROM whole WHERE {IN_REPORT})"
_ROWS = """SELECT message_id, ts_utc, from_username, text, is_investment, sentiment,
  array_to_string(tokens, '|') AS tokens, array_to_string(key_points, '|') AS key_points, topic_key FROM """


def _rows(df):
    return df.select(
        "message_id", I.ntz("ts_utc").alias("ts_utc"), "from_username", "text", "is_investment",
        "sentiment", joined("tokens").alias("tokens"), joined("key_points").alias("key_points"), "topic_key",
    )


@query(f"WITH {_PART} {_ROWS} whole WHERE {IN_REPORT}")
def report_messages(spark, sf):
    """Messages that were never analysed are in the report, with defaults."""
    return _rows(report_frame(spark, sf, replies=False).orderBy(*relational.newest_first()))


@query(
    f"""WITH {FRAME} {_ROWS} frame
WHERE contains(lower(coalesce(topic_key, '')), 'sol') OR list_contains(tokens, 'SOL')"""
)
def report_topic(spark, sf):
    return _rows(report_frame(spark, sf, topic="sol"))


_SUMS = """count(*) AS total_messages, count(*) FILTER (is_investment) AS investment_messages,
  count(*) FILTER (is_investment AND sentiment = 'BULLISH') AS bullish,
  count(*) FILTER (is_investment AND sentiment = 'BEARISH') AS bearish,
  count(*) FILTER (is_investment AND sentiment = 'NEUTRAL') AS neutral"""


def _pct(part: str, base: str) -> str:
    return f"CASE WHEN {base} > 0 THEN round_even({part} / {base}::DOUBLE * 100, 1) ELSE 0.0::DOUBLE END"


def _report_sql(frame: str) -> str:
    return f"""sums AS (SELECT {_SUMS} FROM {frame}),
e AS (SELECT ts_utc, message_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {frame}),
g AS (SELECT token, count(*) AS n, max((ts_utc, message_id, -pos)) AS last_seen FROM e GROUP BY token),
top AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, last_seen DESC) AS r FROM g)
SELECT 'summary' AS section, 1 AS rank, 'total' AS label, total_messages AS value, NULL::DOUBLE AS pct FROM sums
UNION ALL SELECT 'summary', 2, 'investment', investment_messages, {_pct('investment_messages', 'total_messages')} FROM sums
UNION ALL SELECT 'sentiment', 1, 'BULLISH', bullish, {_pct('bullish', 'investment_messages')} FROM sums
UNION ALL SELECT 'sentiment', 2, 'BEARISH', bearish, {_pct('bearish', 'investment_messages')} FROM sums
UNION ALL SELECT 'sentiment', 3, 'NEUTRAL', neutral, {_pct('neutral', 'investment_messages')} FROM sums
UNION ALL SELECT 'tokens', r::INTEGER, token, n, NULL FROM top WHERE r <= 5"""


@query(f"WITH {FRAME}, {_report_sql('frame')}")
def report_rows(spark, sf):
    return report.report_rows(report_frame(spark, sf))


@query(
    f"""WITH {FRAME}, newest AS (SELECT * FROM frame ORDER BY ts_utc DESC, message_id DESC LIMIT 500),
{_report_sql('newest')}"""
)
def report_limit(spark, sf):
    return report.report_rows(report_frame(spark, sf, limit=500))


@query(f"WITH {FRAME} SELECT {_SUMS} FROM frame")
def report_summary(spark, sf):
    return report.totals(report_frame(spark, sf))


@query(
    f"""WITH {FRAME}, s AS (SELECT {_SUMS} FROM frame), l AS (
SELECT 'BULLISH' AS sentiment, bullish AS n, investment_messages AS i FROM s
UNION ALL SELECT 'BEARISH', bearish, investment_messages FROM s
UNION ALL SELECT 'NEUTRAL', neutral, investment_messages FROM s)
SELECT sentiment, n, {_pct('n', 'i')} AS pct FROM l"""
)
def sentiment_breakdown(spark, sf):
    return report.sentiment_breakdown(report_frame(spark, sf))


@query(
    f"""WITH {WHOLE}, s AS (SELECT chat_id, {_SUMS} FROM whole GROUP BY chat_id)
SELECT chat_id, {_pct('investment_messages', 'total_messages')} AS investment_pct,
  {_pct('bullish', 'investment_messages')} AS bullish_pct, {_pct('bearish', 'investment_messages')} AS bearish_pct
FROM s"""
)
def report_pct(spark, sf):
    t = report.totals(whole_frame(spark, sf), ["chat_id"])
    inv = F.col("investment_messages")
    return t.select(
        "chat_id", report.percent(inv, F.col("total_messages")).alias("investment_pct"),
        report.percent(F.col("bullish"), inv).alias("bullish_pct"),
        report.percent(F.col("bearish"), inv).alias("bearish_pct"),
    )


_PREVIEWS = f"""WITH {WHOLE}, h AS (SELECT *, date_trunc('day', ts_utc)::TIMESTAMP AS day FROM whole),
r AS (SELECT *, row_number() OVER (PARTITION BY chat_id, day, from_username ORDER BY ts_utc DESC, message_id DESC) AS rank,
  count(*) OVER (PARTITION BY chat_id, day, from_username) AS size FROM h)
SELECT chat_id, day, from_username, rank::INTEGER AS rank, strftime(ts_utc, '%m-%d %H:%M') AS at,
  coalesce(from_username, 'Unknown') AS author, sentiment,
  array_to_string(list_transform(list_slice(tokens, 1, 3), lambda t: '$' || t), ', ') AS marks,
  CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END AS preview
FROM r WHERE rank <= 5"""


def _previews(spark, sf, **bounds):
    frame = whole_frame(spark, sf).withColumn("day", F.date_trunc("day", "ts_utc"))
    return report.previews(frame, ["chat_id", "day", "from_username"], **bounds).withColumn("day", I.ntz("day"))


@query(_PREVIEWS)
def message_preview(spark, sf):
    """Newest rows of every author's day; those without an author are one large group."""
    return _previews(spark, sf)


@query(f"{_PREVIEWS} AND size <= 10")
def message_preview_small(spark, sf):
    """Only for days of few messages."""
    return _previews(spark, sf, only_up_to=V.PREVIEW_LIMIT)


MENTIONS = f"""{WHOLE}, mentions AS (
SELECT chat_id, message_id, ts_utc, coalesce(nullif(from_username, ''), 'Unknown') AS contributor,
  CASE WHEN sentiment IN ('BULLISH', 'BEARISH') THEN sentiment ELSE 'NEUTRAL' END AS sentiment,
  list_slice(key_points, 1, 2) AS points, unnest(tokens) AS name, generate_subscripts(tokens, 1) AS pos
FROM whole WHERE is_investment),
m AS (SELECT *, '$' || name AS token FROM mentions)"""


def _mentions(spark, sf):
    return token_report.mentions(whole_frame(spark, sf), ["chat_id"])


@query(
    f"""WITH {MENTIONS} SELECT chat_id, token, count(*) AS mentions,
  count(*) FILTER (sentiment = 'BULLISH') AS bullish_count, count(*) FILTER (sentiment = 'BEARISH') AS bearish_count,
  count(*) FILTER (sentiment = 'NEUTRAL') AS neutral_count, count(DISTINCT contributor) AS contributor_count
FROM m GROUP BY chat_id, token"""
)
def token_groups(spark, sf):
    return token_report.counts(_mentions(spark, sf), ["chat_id"]).select(
        "chat_id", "token", F.col("n").alias("mentions"), "bullish_count", "bearish_count",
        "neutral_count", "contributor_count",
    )


@query(f"WITH {MENTIONS} SELECT DISTINCT chat_id, token, contributor FROM m")
def token_contributors(spark, sf):
    return token_report.contributors(_mentions(spark, sf), ["chat_id"])


_POINTS = f"""{MENTIONS}, p AS (SELECT chat_id, token, sentiment, ts_utc, message_id, unnest(points) AS point,
  generate_subscripts(points, 1) - 1 AS place FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY chat_id, token, sentiment
  ORDER BY ts_utc DESC, message_id DESC, place) AS rank FROM p WHERE trim(point) <> '')"""


@query(f"WITH {_POINTS} SELECT chat_id, token, sentiment, ts_utc, message_id, place::INTEGER AS place, point FROM ranked")
def token_points(spark, sf):
    return token_report.points(_mentions(spark, sf), ["chat_id"]).withColumn("ts_utc", I.ntz("ts_utc"))


@query(
    f"""WITH {_POINTS} SELECT chat_id, token, sentiment, rank::INTEGER AS rank, point FROM ranked
WHERE rank <= 4 AND sentiment <> 'NEUTRAL'"""
)
def token_leading_points(spark, sf):
    return token_report.leading_points(_mentions(spark, sf), ["chat_id"]).drop("ts_utc", "message_id")


_FLAT = """c AS (SELECT {by} token, count(*) AS mentions, max((ts_utc, message_id, -pos)) AS last_seen,
  count(*) FILTER (sentiment = 'BULLISH') AS bullish_count, count(*) FILTER (sentiment = 'BEARISH') AS bearish_count,
  count(*) FILTER (sentiment = 'NEUTRAL') AS neutral_count, count(DISTINCT contributor) AS contributor_count,
  list_sort(list(DISTINCT contributor)) AS names FROM m GROUP BY {by} token),
l AS (SELECT {by} token, list(point ORDER BY rank) FILTER (sentiment = 'BULLISH' AND rank <= 4) AS bull,
  list(point ORDER BY rank) FILTER (sentiment = 'BEARISH' AND rank <= 4) AS bear FROM ranked GROUP BY {by} token)
SELECT {by} token, mentions, bullish_count, bearish_count, neutral_count, contributor_count,
  array_to_string(list_slice(names, 1, 8), ', ') ||
    CASE WHEN contributor_count > 8 THEN ' +' || (contributor_count - 8) || ' more' ELSE '' END AS contributors,
  coalesce(array_to_string(bull, '|'), '') AS bullish_points, coalesce(array_to_string(bear, '|'), '') AS bearish_points,
  coalesce(len(bull), 0) = 0 AND coalesce(len(bear), 0) = 0 AS no_direction
FROM c LEFT JOIN l USING ({using})"""


@query(f"WITH {_POINTS}, {_FLAT.format(by='chat_id,', using='chat_id, token')}")
def token_flat(spark, sf):
    rows = token_report.token_report(settled(_mentions(spark, sf), "mentions"), ["chat_id"])
    return rows.withColumns(
        {"bullish_points": joined("bullish_points"), "bearish_points": joined("bearish_points")}
    )


_EXPORT = f"""WITH {FRAME} SELECT message_id::VARCHAR AS message_id,
  CASE WHEN microsecond(ts_utc) % 1000000 = 0 THEN strftime(ts_utc, '%Y-%m-%dT%H:%M:%S+00:00')
    ELSE strftime(ts_utc, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS timestamp,
  from_username AS username, text, CASE WHEN is_investment THEN 'True' ELSE 'False' END AS is_investment,
  sentiment, nullif(array_to_string(tokens, ', '), '') AS tokens, topic_key,
  nullif(array_to_string(key_points, '; '), '') AS key_points FROM frame"""


@query(_EXPORT)
def export_csv_roundtrip(spark, sf):
    path = scratch_folder(spark, "export")
    csv_export.write_csv(report_frame(spark, sf), path)
    return csv_export.read_csv(spark, path)


@query(f"WITH {I.REQUESTS_SQL} SELECT request_id, start_ts, end_ts FROM requests")
def parse_ranges(spark, sf):
    c = ranges.parse_range(F.col("range_text"), F.col("now_ts"))
    return I.requests(spark, sf).withColumn("r", c).select(
        "request_id", I.ntz("r.start_ts").alias("start_ts"), I.ntz("r.end_ts").alias("end_ts")
    )


_DATE_FORMS = ("yyyy-MM-dd", "yyyy-M-d", "MM-dd", "M/d", "MM/dd/yyyy", "M-d-yyyy", "yyyy-MM-dd HH:mm")


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (2, 3)
  THEN try_cast('2024-' || strftime(o_orderdate, '%m-%d') AS TIMESTAMP) ELSE o_orderdate END AS parsed
FROM orders WHERE o_orderkey % 7 NOT IN (2, 3) OR strftime(o_orderdate, '%m-%d') <> '02-29'
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 IN (2, 3) AND strftime(o_orderdate, '%m-%d') = '02-29'"""
)
def parse_dates(spark, sf):
    """Every order date written in one of seven forms and read back."""
    kind, date = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    text = F.lit(None).cast("string")
    for i, form in enumerate(_DATE_FORMS):
        text = F.when(kind == i, F.date_format(date, form)).otherwise(text)
    return I.table(spark, sf, "orders").select(
        "o_orderkey", I.ntz(ranges.parse_date(text, I.at(I.NOW))).alias("parsed")
    )


@query(
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment
  WHEN 2 THEN '$' || c_mktsegment WHEN 3 THEN NULL ELSE upper(c_name) END AS topic FROM customer"""
)
def parse_topics(spark, sf):
    segment, name = F.lower("c_mktsegment"), F.lower("c_name")
    forms = (
        F.concat(F.lit("topic:"), segment), F.concat(F.lit(" Topic: $"), segment),
        F.concat(F.lit("$$"), segment), F.lit("topic: $"), F.concat(name, F.lit("  ")),
    )
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))
    return I.table(spark, sf, "customer").select("c_custkey", ranges.parse_topic(text).alias("topic"))


@query(
    """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 1 THEN -floor(o_totalprice / 10)::BIGINT
  ELSE floor(o_totalprice / 10)::BIGINT END AS asked FROM orders)
SELECT o_orderkey, CASE WHEN asked IS NOT NULL THEN greatest(1, asked) END AS row_limit,
  CASE WHEN asked IS NOT NULL THEN least(10000, greatest(1, asked)) END AS bounded,
  CASE WHEN asked IS NOT NULL THEN asked NOT BETWEEN 1 AND 10000 END AS was_cut FROM n"""
)
def parse_limits(spark, sf):
    """Limits as asked for, and with a bound of its own column."""
    n = F.floor(F.col("o_totalprice") / 10).cast("string")
    forms = (F.concat(F.lit("limit:"), n), F.concat(F.lit("-"), n), F.concat(F.lit(" "), n),
             F.concat(n, F.lit(".5")))
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return I.table(spark, sf, "orders").select(
        "o_orderkey", ranges.parse_limit(text).alias("row_limit"), ranges.parse_limit(text, V.LIMIT_MAX).alias("bounded"),
        ranges.limit_was_cut(text, V.LIMIT_MAX).alias("was_cut"),
    )


@query(
    """SELECT o_orderkey, 'last ' || (o_orderkey % 30) || 'd' AS range_text,
  'topic:' || o_orderpriority[1:1] AS topic_text,
  CASE WHEN o_orderkey % 2 = 0 THEN 'limit:' || o_custkey END AS limit_text FROM orders"""
)
def parse_args(spark, sf):
    key = F.col("o_orderkey")
    words = [
        F.lit("last"), F.lit("topic:old"), F.when(key % 2 == 0, F.concat(F.lit("limit:"), "o_custkey")),
        F.concat((key % 30).cast("string"), F.lit("d")),
        F.concat(F.lit("topic:"), F.substring("o_orderpriority", 1, 1)),
    ]
    parts = ranges.split_arguments(F.concat_ws("  ", *words))
    return I.table(spark, sf, "orders").withColumn("p", parts).select("o_orderkey", "p.*")


_MATCHED = f"""{WHOLE}, {I.REQUESTS_SQL},
hits AS (SELECT w.*, r.request_id, r.row_limit, row_number() OVER (PARTITION BY r.request_id
    ORDER BY w.ts_utc DESC, w.message_id DESC) AS rn
  FROM whole w JOIN requests r ON w.chat_id = r.chat_id AND w.ts_utc BETWEEN r.start_ts AND r.end_ts
    AND (r.topic IS NULL OR contains(lower(coalesce(w.topic_key, '')), lower(r.topic)) OR list_contains(w.tokens, upper(r.topic)))),
matched AS (SELECT * FROM hits WHERE row_limit IS NULL OR rn <= row_limit)"""


@query(
    f"""WITH {_MATCHED}, sums AS (SELECT request_id, {_SUMS} FROM matched GROUP BY request_id),
e AS (SELECT request_id, ts_utc, message_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM matched),
g AS (SELECT request_id, token, count(*) AS n, max((ts_utc, message_id, -pos)) AS last_seen FROM e GROUP BY request_id, token),
t AS (SELECT request_id, token, n, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, last_seen DESC) AS r FROM g),
line AS (SELECT request_id, string_agg(token || ':' || n, ', ' ORDER BY r) AS top_tokens FROM t WHERE r <= 5 GROUP BY request_id)
SELECT q.request_id, CASE WHEN q.start_ts IS NULL THEN 'date range' END AS error,
  coalesce(total_messages, 0) AS total_messages, coalesce(investment_messages, 0) AS investment_messages,
  coalesce(bullish, 0) AS bullish, coalesce(bearish, 0) AS bearish, coalesce(neutral, 0) AS neutral,
  coalesce(top_tokens, '') AS top_tokens
FROM requests q LEFT JOIN sums USING (request_id) LEFT JOIN line USING (request_id)"""
)
def batch_reports(spark, sf):
    return requests.batch_reports(whole_frame(spark, sf), parsed_requests(spark, sf))


@query(f"WITH {_MATCHED} SELECT request_id, chat_id, message_id FROM matched")
def batch_matches(spark, sf):
    # the plan is written several times on the way, so only what it reads goes in
    frame = whole_frame(spark, sf).select(*S.KEY, "ts_utc", "topic_key", "tokens")
    return requests.match(frame, parsed_requests(spark, sf)).select("request_id", *S.KEY)


_REQUEST_MENTIONS = f"""{_MATCHED}, mentions AS (
SELECT request_id, message_id, ts_utc, coalesce(nullif(from_username, ''), 'Unknown') AS contributor,
  CASE WHEN sentiment IN ('BULLISH', 'BEARISH') THEN sentiment ELSE 'NEUTRAL' END AS sentiment,
  list_slice(key_points, 1, 2) AS points, unnest(tokens) AS name, generate_subscripts(tokens, 1) AS pos
FROM matched WHERE is_investment),
m AS (SELECT *, '$' || name AS token FROM mentions),
p AS (SELECT request_id, token, sentiment, ts_utc, message_id, unnest(points) AS point,
  generate_subscripts(points, 1) - 1 AS place FROM m),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id, token, sentiment
  ORDER BY ts_utc DESC, message_id DESC, place) AS rank FROM p WHERE trim(point) <> '')"""


@query(f"WITH {_REQUEST_MENTIONS}, {_FLAT.format(by='request_id,', using='request_id, token')}")
def batch_token_reports(spark, sf):
    found = requests.batch_token_reports(whole_frame(spark, sf), parsed_requests(spark, sf))
    return found.withColumns({"bullish_points": joined("bullish_points"), "bearish_points": joined("bearish_points")})


# Whole documents and whole conversations as the messages of one chat.
_TEXT_START = "2024-01-01 00:00:00"


def _as_chats(rows, number):
    """Rows with ``text`` as messages of one chat: numbered, a minute apart."""
    n = F.col("message_id")
    return rows.withColumn("message_id", number).select(
        F.lit(CHAT).cast("long").alias("chat_id"), n.alias("message_id"),
        F.timestamp_seconds(F.unix_timestamp(I.at(_TEXT_START)) + 60 * n.cast("long")).alias("ts_utc"),
        F.concat(F.lit("user_"), (n % 7).cast("string")).alias("from_username"), "text",
    )


def _text_report(messages):
    """Report over all times of the chat."""
    analysis = analyse.analyse(messages, I.at(I.ANALYSED_AT), mode=analyse.LEXICON)
    joined = relational.with_analysis(relational.of_chat(messages, CHAT), relational.of_chat(analysis, CHAT))
    return report.report_rows(relational.report_columns(joined))


def _text_report_sql(source: str) -> str:
    verdict, _ = Q.lexicon_verdict()
    return f"""m AS (SELECT {CHAT} AS chat_id, message_id,
  TIMESTAMP '{_TEXT_START}' + to_minutes(message_id) AS ts_utc, text FROM ({source})),
c AS (SELECT * FROM m WHERE chat_id = {CHAT}), {Q.annotated('a', 'c', 'message_id')},
frame AS (SELECT message_id, ts_utc, is_investment, {verdict} AS sentiment, tokens FROM a), {_report_sql('frame')}"""


@query(f"WITH {I.PROSE_SQL}, {_text_report_sql('SELECT doc_id AS message_id, text FROM prose')}")
def report_documents(spark, sf):
    """Standard report with all whole documents as messages."""
    return _text_report(_as_chats(I.prose(spark, sf), F.col("doc_id")))


@query(f"WITH {_text_report_sql('SELECT conv_id * 1000 + turn AS message_id, text FROM conversations')}")
def report_conversations(spark, sf):
    """Standard report with all whole turns as messages."""
    number = F.col("chat_id") * 1000 + F.col("message_id")
    return _text_report(_as_chats(I.conversation_messages(spark, sf), number))


@query(
    f"""WITH {I.PROSE_SQL}, m AS (SELECT doc_id AS message_id, text, TIMESTAMP '{_TEXT_START}' + to_minutes(doc_id) AS ts_utc FROM prose),
{Q.annotated('a', 'm', 'message_id')},
q AS (SELECT doc_id AS request_id, nullif(substr(text, 3, 4), '') AS topic, CASE WHEN doc_id % 2 = 0 THEN doc_id % 50 + 1 END AS row_limit
  FROM documents),
hits AS (SELECT request_id, message_id, row_limit, row_number() OVER (PARTITION BY request_id ORDER BY ts_utc DESC, message_id DESC) AS rn
  FROM a JOIN q ON q.topic IS NULL OR contains(lower(coalesce(a.topic_key, '')), lower(q.topic)) OR list_contains(a.tokens, upper(q.topic)))
SELECT request_id, count(*) AS n, min(message_id) AS oldest, max(message_id) AS newest
FROM hits WHERE row_limit IS NULL OR rn <= row_limit GROUP BY 1"""
)
def batch_text_topics(spark, sf):
    """A request for each document, with letters of its text as topic, over all documents as messages."""
    messages = _as_chats(I.prose(spark, sf), F.col("doc_id"))
    frame = relational.report_columns(relational.with_analysis(messages, analyse.analyse(messages, I.at(I.ANALYSED_AT))))
    topic, number = F.substring("text", 3, 4), F.col("doc_id")
    asked = I.table(spark, sf, "documents").select(
        number.alias("request_id"), F.lit(CHAT).cast("long").alias("chat_id"), I.at(_TEXT_START).alias("start_ts"),
        I.at("9999-01-01 00:00:00").alias("end_ts"), F.when(topic != "", topic).alias("topic"),
        F.when(number % 2 == 0, number % 50 + 1).alias("row_limit"), F.lit(None).cast("string").alias("error"),
    )
    frame = frame.select("chat_id", "message_id", "ts_utc", "topic_key", "tokens")
    return requests.match(frame, asked).groupBy("request_id").agg(
        F.count("*").alias("n"), F.min("message_id").alias("oldest"), F.max("message_id").alias("newest")
    )

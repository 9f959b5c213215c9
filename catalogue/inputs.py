"""Chat tables derived from the driver's tables, once for Spark and once as SQL.

Each derivation is a pure function of whole given tables: every event becomes
a message, every document a prose text, every conversation a report request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.sources.session import spread


TEMPLATES = (
    "$BTC to 100K by december, target $120K",
    "$eth and $btc both strong, new high soon",
    "Bitcoin crash incoming, sell everything",
    "gm everyone",
    "The staking apr on this validator is fine",
    "token unlock tomorrow",
    "Raised $10M at $50MIL valuation, nothing else",
    "$SOL flips $ETH and SOL pumping, up 60% in january",
    "token buybacks funded by revenue generation for $UNI holders",
    "Whale accumulation seen, ETF filing expected for solana soon",
    "Read https://example.org/a?b=1 about $DOT and $LINK",
    "$AVAX rejection at resistance, avoid this bubble",
    "buy the dump",
    "price price and again price",
    "alice\n$BTC looks weak but I hold",
    "bob smith\nNothing about money here at all",
    "check http://example.org first\nsecond line of text",
    "$TOOLONGTOKEN1 is not matched but $LONGTOKEN1 is",
    "governance proposal vote is live, bullish on $ADA",
    "Chainlink first mover in enterprise contracts",
    "short and long positions were liquidated on $BNB",
    "Polygon and Polkadot and Avalanche and Uniswap all rally",
    "no signal in this quiet little line",
    "$ARB mcap 500M MC and fear everywhere, paper hands",
)

NOW = "2024-01-31 00:00:00"
ANALYSED_AT = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(scan) if name in ("events", "documents", "conversations", "pages") else scan


def at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def ntz(c: Column | str) -> Column:
    """Timestamps leave a query without a zone, as the SQL side has them."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def _hours(n: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(n), F.lit(0), F.lit(0.0))


def messages(spark: SparkSession, sf_dir: str, text: Column | None = None) -> DataFrame:
    """One message per event, with ``ingest_seq`` in arrival order."""
    texts = F.array(*[F.lit(t) for t in TEMPLATES])
    ev, user = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    body = F.element_at(texts, (ev % len(TEMPLATES) + 1).cast("int")) if text is None else text
    return table(spark, sf_dir, "events").select(
        (user % 3 + 1).alias("chat_id"),
        (ev + 1).alias("message_id"),
        ts.alias("ts_utc"),
        user.alias("from_user_id"),
        F.when(user % 7 != 0, F.concat(F.lit("user_"), user.cast("string"))).alias("from_username"),
        (F.col("event_type") == "view").alias("is_forwarded"),
        F.when(
            F.col("event_type") == "view", F.concat(F.lit("channel_"), (user % 11).cast("string"))
        ).alias("forward_from"),
        body.alias("text"),
        F.when(
            ev % 24 == 10, F.array(F.lit("https://example.org/a?b=1"))
        ).otherwise(F.array().cast("array<string>")).alias("urls"),
        F.when(F.col("event_type") == "click", ev).alias("reply_to_id"),
        F.when(ev % 10 == 0, ts + _hours(3)).alias("edit_date"),
        F.lit(None).cast("timestamp").alias("created_at"),
        ev.alias("ingest_seq"),
    )


MESSAGES_SQL = """messages AS (
  SELECT user_id % 3 + 1 AS chat_id, event_id + 1 AS message_id, ts AS ts_utc,
         user_id AS from_user_id,
         CASE WHEN user_id % 7 <> 0 THEN 'user_' || user_id END AS from_username,
         event_type = 'view' AS is_forwarded,
         CASE WHEN event_type = 'view' THEN 'channel_' || (user_id % 11) END AS forward_from,
         [{texts}][event_id % 24 + 1] AS text,
         CASE WHEN event_id % 24 = 10 THEN 'https://example.org/a?b=1' ELSE '' END AS urls,
         CASE WHEN event_type = 'click' THEN event_id END AS reply_to_id,
         CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 3 HOUR END AS edit_date,
         event_id AS ingest_seq
  FROM events)""".format(
    texts=", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in TEMPLATES)
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores: exact hundredths computed from the event number."""
    ev = F.col("event_id")
    part = lambda k: (ev * k % 101) / F.lit(100.0)
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3 + 1).alias("chat_id"),
        (ev + 1).alias("message_id"),
        part(37).alias("positive"),
        part(53).alias("negative"),
        part(29).alias("neutral"),
    )


SCORES_SQL = """scores AS (
  SELECT user_id % 3 + 1 AS chat_id, event_id + 1 AS message_id,
         (event_id * 37 % 101) / 100.0::DOUBLE AS positive,
         (event_id * 53 % 101) / 100.0::DOUBLE AS negative,
         (event_id * 29 % 101) / 100.0::DOUBLE AS neutral
  FROM events)"""

# Frequent words of the documents turned into market talk, so that every text
# function meets many hits in long, whole texts.
TALK = (
    (" the ", " $btc "), (" of ", " pump "), (" and ", " bitcoin "), (" in ", " staking "),
    (" for ", " first mover "), (" on ", " target $50K "), (" is ", " buybacks "),
    (" la ", " ethereum "), (" le ", " crash "), (" un ", " up 20% in "), (" des ", " buybacks "),
    (" der ", " revenue generation "), (" die ", " $sol "), (" el ", " strong "), (" que ", " sell "),
)


def talk(c: Column) -> Column:
    for old, new in TALK:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", talk(F.col("text")).alias("text"))


def _sql_talk(expr: str) -> str:
    for old, new in TALK:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


PROSE_SQL = f"prose AS (SELECT doc_id, {_sql_talk('text')} AS text FROM documents)"


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"),
        F.col("role").alias("handle"), "text",
    )


RANGES = (
    "last 24h", "last 7d", "last 2w", "2024-01-05 to 2024-01-12", "2024-01-15",
    "1/20/2024", "01-17", "2024-01-10 10:30", "Last 3d", "last 5x", "yesterday",
    "2024-02-30", "1/3 to 1/9", "2024-1-2 to 01-25-2024",
)
TOPICS = ("topic:btc", "$ETH", "", "staking", "topic:$sol", None)
LIMITS = ("limit:25", "0", None, "20000", "x", "7")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report request per conversation."""
    conv = F.col("conv_id")

    def pick(options: tuple) -> Column:
        texts = F.array(*[F.lit(o).cast("string") for o in options])
        return F.element_at(texts, (conv % len(options) + 1).cast("int"))

    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id").distinct()
        .select(
            conv.alias("request_id"),
            (conv % 3 + 1).alias("chat_id"),
            pick(RANGES).alias("range_text"),
            pick(TOPICS).alias("topic_text"),
            pick(LIMITS).alias("limit_text"),
            at(NOW).alias("now_ts"),
        )
    )


def _sql_pick(options: tuple) -> str:
    texts = ", ".join("NULL" if o is None else f"'{o}'" for o in options)
    return f"([{texts}])[conv_id % {len(options)} + 1]"


# The ranges above worked out by hand: (start, end) or None where they are no range.
RANGE_BOUNDS = (
    ("2024-01-30 00:00:00", NOW), ("2024-01-24 00:00:00", NOW), ("2024-01-17 00:00:00", NOW),
    ("2024-01-05 00:00:00", "2024-01-12 23:59:59"), ("2024-01-15 00:00:00", "2024-01-15 23:59:59"),
    ("2024-01-20 00:00:00", "2024-01-20 23:59:59"), ("2024-01-17 00:00:00", "2024-01-17 23:59:59"),
    ("2024-01-10 00:00:00", "2024-01-10 23:59:59"), ("2024-01-28 00:00:00", NOW), None, None,
    None, ("2024-01-03 00:00:00", "2024-01-09 23:59:59"), ("2024-01-02 00:00:00", "2024-01-25 23:59:59"),
)
TOPIC_VALUES = ("BTC", "ETH", None, "STAKING", "SOL", None)
LIMIT_VALUES = (25, 1, None, 20000, None, 7)


def _sql_values(values: tuple, cast: str) -> str:
    texts = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{texts}])[conv_id % {len(values)} + 1]::{cast}"


REQUESTS_SQL = f"""requests AS (
  SELECT conv_id AS request_id, conv_id % 3 + 1 AS chat_id,
         {_sql_values(tuple(b and b[0] for b in RANGE_BOUNDS), 'TIMESTAMP')} AS start_ts,
         {_sql_values(tuple(b and b[1] for b in RANGE_BOUNDS), 'TIMESTAMP')} AS end_ts,
         {_sql_values(TOPIC_VALUES, 'VARCHAR')} AS topic,
         {_sql_values(LIMIT_VALUES, 'BIGINT')} AS row_limit
  FROM (SELECT DISTINCT conv_id FROM conversations))"""


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as they arrive: each once, some edited later, some replayed stale.

    ``ingest_seq`` orders all arrivals. An edit comes after all first arrivals
    and a stale replay after that.
    """
    base = messages(spark, sf_dir).withColumn("ingest_seq", F.col("ingest_seq") * 3)
    hours = lambda n: F.col("ts_utc") + _hours(n)
    ev = F.col("message_id") - 1
    copies = F.array(
        F.struct(F.lit(0).alias("kind"), F.col("edit_date").alias("at")),
        F.struct(F.lit(1).alias("kind"), F.when(ev % 10 == 0, hours(5)).alias("at")),
        F.struct(F.lit(2).alias("kind"), F.when(ev % 15 == 0, hours(1)).alias("at")),
    )
    late = 3_000_000_000_000
    return (
        base.withColumn("c", F.explode(F.filter(copies, lambda c: (c["kind"] == 0) | c["at"].isNotNull())))
        .withColumns(
            {
                "edit_date": F.col("c.at"),
                "text": F.concat("text", F.when(F.col("c.kind") == 1, F.lit(" (edited)"))
                                 .when(F.col("c.kind") == 2, F.lit(" (stale)")).otherwise(F.lit(""))),
                "ingest_seq": F.col("ingest_seq") + F.col("c.kind") * F.lit(late),
                "from_username": F.when(F.col("c.kind") == 0, F.col("from_username")).otherwise(F.lit("replay")),
            }
        )
        .drop("c")
    )


ARRIVALS_SQL = """arrivals AS (
  SELECT chat_id, message_id, ts_utc, from_username, text, urls, edit_date, ingest_seq * 3 AS ingest_seq
  FROM messages
  UNION ALL
  SELECT chat_id, message_id, ts_utc, 'replay', text || ' (edited)', urls, ts_utc + INTERVAL 5 HOUR,
         ingest_seq * 3 + 3000000000000
  FROM messages WHERE (message_id - 1) % 10 = 0
  UNION ALL
  SELECT chat_id, message_id, ts_utc, 'replay', text || ' (stale)', urls, ts_utc + INTERVAL 1 HOUR,
         ingest_seq * 3 + 6000000000000
  FROM messages WHERE (message_id - 1) % 15 = 0)"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows before normalisation: nested entities and forward headers."""
    ev, user = F.col("event_id"), F.col("user_id")
    texts = F.array(*[F.lit(t) for t in TEMPLATES])
    ts = F.col("ts").cast("timestamp")
    link = lambda c: F.struct(c.cast("string").alias("url"))
    return table(spark, sf_dir, "events").select(
        (user % 3 + 1).alias("chat_id"),
        ev.alias("id"),
        ts.alias("date"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(
            F.element_at(texts, (ev % len(TEMPLATES) + 1).cast("int"))
        ).alias("message"),
        F.when(
            F.col("event_type") != "click",
            F.array(
                link(F.concat(F.lit("https://a.example/"), ev.cast("string"))),
                link(F.lit(None)),
                link(F.lit("")),
                link(F.concat(F.lit("https://b.example/"), F.get_json_object("props", "$.k"))),
            ),
        ).alias("entities"),
        F.when(user % 5 != 0, user).alias("sender_id"),
        F.when(
            F.col("event_type") == "view",
            F.struct(
                F.when(user % 2 == 0, F.concat(F.lit("origin "), user.cast("string"))).alias("from_name"),
                F.when(user % 3 != 0, user).alias("from_id"),
            ),
        ).alias("forward"),
        F.when(F.col("event_type") == "click", ev - 1).alias("reply_to_msg_id"),
        F.when(ev % 10 == 0, ts + _hours(3)).alias("edit_date"),
        ev.alias("ingest_seq"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sender directory: the customers; some are channels, some have no handle."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name")).alias("username"),
        F.when(F.col("c_nationkey") % 5 != 0, "user").otherwise("channel").alias("kind"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward origins: the suppliers; a channel has a title, a user only a handle."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("entity_id"),
        F.when(key % 2 == 0, F.col("s_name")).alias("title"),
        F.when(key % 3 != 0, F.concat(F.lit("handle_"), key.cast("string"))).alias("username"),
    )


RAW_SQL = """raw AS (
  SELECT user_id % 3 + 1 AS chat_id, event_id AS id, ts AS date,
         CASE WHEN event_type = 'error' THEN '' ELSE [{texts}][event_id % 24 + 1] END AS message,
         CASE WHEN event_type <> 'click' THEN
           'https://a.example/' || event_id || ' https://b.example/' || json_extract_string(props, '$.k')
           ELSE '' END AS urls,
         CASE WHEN user_id % 5 <> 0 THEN user_id END AS sender_id,
         event_type = 'view' AS is_forwarded,
         CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'origin ' || user_id END AS from_name,
         CASE WHEN event_type = 'view' AND user_id % 3 <> 0 THEN user_id END AS from_id,
         CASE WHEN event_type = 'click' THEN event_id - 1 END AS reply_to_id,
         CASE WHEN event_id % 10 = 0 THEN ts + INTERVAL 3 HOUR END AS edit_date
  FROM events),
users AS (
  SELECT c_custkey AS user_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS username,
         CASE WHEN c_nationkey % 5 <> 0 THEN 'user' ELSE 'channel' END AS kind
  FROM customer),
entities AS (
  SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title,
         CASE WHEN s_suppkey % 3 <> 0 THEN 'handle_' || s_suppkey END AS username
  FROM supplier)""".format(
    texts=", ".join("'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for t in TEMPLATES)
)



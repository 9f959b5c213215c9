"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue import sql_text as Q
from catalogue.registry import query
from chatlens.functions import keypoints, sentiment, tokens
from chatlens.functions import vocabulary as V
from chatlens.functions.text import strip
from chatlens.operators import analyse, report, scoring
from chatlens.operators.relational import in_range, of_chat
from chatlens.sources import schemas as S


def joined(c):
    return F.array_join(c, "|")


M = I.MESSAGES_SQL
START, END = "2024-01-01 00:00:00", "2024-01-07 23:59:59"


@query(
    f"""WITH {M}, t AS (SELECT *, {Q.tokens('upper(text)')} AS tokens FROM messages
  WHERE chat_id = 1 AND ts_utc BETWEEN '{START}' AND '{END}'),
e AS (SELECT ts_utc, message_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM t),
g AS (SELECT token, count(*) AS n, max((ts_utc, message_id, -pos)) AS last_seen FROM e GROUP BY token)
SELECT token, n FROM g ORDER BY n DESC, last_seen DESC LIMIT 10"""
)
def token_top10(spark, sf):
    rows = in_range(of_chat(I.messages(spark, sf), 1), I.at(START), I.at(END))
    return report.top_tokens(analyse.with_tokens(rows))


@query(
    f"""WITH {M} SELECT chat_id, message_id,
  array_to_string({Q.cashtags('upper(text)')}, '|') AS cashtags,
  array_to_string({Q.asset_cashtags('upper(text)')}, '|') AS assets FROM messages"""
)
def cashtags(spark, sf):
    up = F.upper("text")
    return I.messages(spark, sf).select(
        *S.KEY, joined(tokens.cashtags(up)).alias("cashtags"),
        joined(tokens.asset_cashtags(up)).alias("assets"),
    )


@query(
    f"""WITH {M} SELECT chat_id, message_id,
  array_to_string(list_sort({Q.aliases('upper(text)')}), '|') AS aliases FROM messages"""
)
def aliases(spark, sf):
    return I.messages(spark, sf).select(
        *S.KEY, joined(F.array_sort(tokens.alias_tokens(F.upper("text")))).alias("aliases")
    )


@query(
    f"""WITH {M} SELECT chat_id, message_id,
  array_to_string({Q.tokens('upper(text)')}, '|') AS tokens FROM messages"""
)
def tokens_all(spark, sf):
    return analyse.with_tokens(I.messages(spark, sf)).select(
        *S.KEY, joined("tokens").alias("tokens")
    )


@query(
    f"""WITH {I.PROSE_SQL} SELECT doc_id,
  ({Q.finance_hits(Q.ascii_words('text'))})::BIGINT AS hits FROM prose"""
)
def finance_keyword_hits(spark, sf):
    return I.prose(spark, sf).select(
        "doc_id", tokens.finance_hits(F.col("text")).cast("long").alias("hits")
    )


@query(
    f"""WITH {M}, {Q.annotated('a', 'messages', 'message_id')}
SELECT chat_id, message_id, hits::BIGINT AS hits, is_investment FROM a"""
)
def investment_flag(spark, sf):
    return analyse.with_flags(I.messages(spark, sf)).select(
        *S.KEY, tokens.finance_hits(strip(F.col("text"))).cast("long").alias("hits"),
        "is_investment",
    )


_PROSE_SCORES = f"""WITH {I.PROSE_SQL}, low AS (SELECT doc_id, lower({Q.ascii_words('text')}) AS low FROM prose),
f AS (SELECT doc_id, ({Q.family_score('low', V.BULLISH_FAMILIES)})::BIGINT AS bullish,
  ({Q.family_score('low', V.BEARISH_FAMILIES)})::BIGINT AS bearish FROM low)
SELECT *, CASE WHEN bullish > bearish THEN 'BULLISH' WHEN bearish > bullish THEN 'BEARISH'
  ELSE 'NEUTRAL' END AS sentiment FROM f"""


@query(_PROSE_SCORES)
def keyword_sentiment(spark, sf):
    low = F.lower("text")
    return (
        I.prose(spark, sf)
        .select(
            "doc_id",
            sentiment.bullish_score(low).cast("long").alias("bullish"),
            sentiment.bearish_score(low).cast("long").alias("bearish"),
        )
        .withColumn(
            "sentiment", sentiment.keyword_sentiment(F.col("bullish"), F.col("bearish"))
        )
    )


_MODEL = """SELECT chat_id, message_id,
  CASE WHEN NOT is_investment THEN 'NEUTRAL'
       WHEN (choice = 'NEUTRAL' OR best < 0.7) AND keyword <> 'NEUTRAL' THEN keyword
       WHEN best < 0.7 THEN 'NEUTRAL' ELSE choice END AS sentiment,
  CASE WHEN NOT is_investment THEN NULL
       WHEN (choice = 'NEUTRAL' OR best < 0.7) AND keyword <> 'NEUTRAL' THEN greatest(best, 0.6)
       ELSE best END AS confidence
FROM c"""


@query(
    f"""WITH {M}, {I.SCORES_SQL}, {Q.annotated('a', 'messages', 'message_id')},
c AS (SELECT a.*, greatest(positive, negative, neutral) AS best,
  CASE WHEN positive >= negative AND positive >= neutral THEN 'BULLISH'
       WHEN negative >= neutral THEN 'BEARISH' ELSE 'NEUTRAL' END AS choice
  FROM a JOIN scores USING (chat_id, message_id))
{_MODEL}"""
)
def model_sentiment(spark, sf):
    done = analyse.analyse(
        I.messages(spark, sf), I.at(I.ANALYSED_AT), scores=I.scores(spark, sf)
    )
    return done.select(*S.KEY, "sentiment", "confidence")


def _by_length(chars: str) -> str:
    """SQL of a model whose scores depend on the length of what it is given."""
    return f"""WITH {M}, {Q.annotated('a', 'messages', 'message_id')},
n AS (SELECT *, length({chars}) AS len FROM a),
s AS (SELECT *, (len * 37 % 101) / 100.0::DOUBLE AS positive, (len * 53 % 101) / 100.0::DOUBLE AS negative,
  (len * 29 % 101) / 100.0::DOUBLE AS neutral FROM n),
c AS (SELECT *, greatest(positive, negative, neutral) AS best,
  CASE WHEN positive >= negative AND positive >= neutral THEN 'BULLISH'
       WHEN negative >= neutral THEN 'BEARISH' ELSE 'NEUTRAL' END AS choice FROM s)
"""


def _stand_in(fails_on: str | None = None):
    """A stand-in for a real model: scores that depend on the text's length only."""

    # Defined here so that it travels to the executors by value.
    def load():
        import pandas as pd

        def score(texts):
            if fails_on is not None and texts.str.contains(fails_on, regex=False).any():
                raise ValueError("no score")
            n = texts.str.len().to_numpy("int64")
            return pd.DataFrame(
                {"positive": n * 37 % 101 / 100.0, "negative": n * 53 % 101 / 100.0,
                 "neutral": n * 29 % 101 / 100.0}
            )

        return score

    return load


def _by_model(spark, sf, fails_on=None, max_chars=None):
    flagged = analyse.with_flags(I.messages(spark, sf).select(*S.KEY, "text"))
    scored = scoring.with_scores(flagged, _stand_in(fails_on), max_chars=max_chars)
    return analyse.with_verdict(scored).select(*S.KEY, "sentiment", "confidence")


@query(f"{_by_length(Q.strip('text'))} {_MODEL}")
def model_sentiment_udf(spark, sf):
    """Whole texts go to the model."""
    return _by_model(spark, sf)


@query(f"{_by_length('substring(' + Q.strip('text') + ', 1, 20)')} {_MODEL}")
def model_sentiment_bounded(spark, sf):
    """A model that takes only so many characters."""
    return _by_model(spark, sf, max_chars=20)


@query(
    f"""SELECT chat_id, message_id, CASE WHEN failed THEN 'NEUTRAL' ELSE sentiment END AS sentiment,
  CASE WHEN failed THEN 0.0::DOUBLE ELSE confidence END AS confidence
FROM ({_by_length(Q.strip('text'))} {_MODEL.replace('SELECT chat_id', "SELECT is_investment AND contains(text, 'soon') AS failed, chat_id", 1)})"""
)
def model_sentiment_failing(spark, sf):
    """A model that fails on some texts costs these their score and nothing else."""
    return _by_model(spark, sf, fails_on="soon")


def _word_places():
    """A stand-in for the tokenizer of a model: words between ASCII white space."""
    def load():
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        return lambda text: [m.span() for m in word.finditer(text)]

    return load


def _letter_model():
    """A stand-in for a model: scores by the number of letters, white space left out."""
    def load():
        import pandas as pd

        def score(texts):
            n = texts.str.replace(r"[\x20\x09-\x0D]+", "", regex=True).str.len().to_numpy("int64")
            return pd.DataFrame({"positive": n * 37 % 101 / 100.0, "negative": n * 53 % 101 / 100.0, "neutral": n * 29 % 101 / 100.0})

        return score

    return load


@query(
    rf"""WITH {I.PROSE_SQL}, m AS (SELECT 1::BIGINT AS chat_id, doc_id AS message_id, text FROM prose),
{Q.annotated('a', 'm', 'message_id')},
w AS (SELECT *, regexp_extract_all({Q.strip('text')}, '[^ 	-
]+') AS words FROM a WHERE is_investment),
i AS (SELECT *, unnest(range(0, greatest(len(words) - 50, 1), 460)) AS i FROM w),
n AS (SELECT *, length(array_to_string(words[i + 1:i + 510], '')) AS len,
  greatest(least(510, len(words) - i) - CASE WHEN i > 0 THEN 50 ELSE 0 END, 1) AS weight FROM i),
s AS (SELECT chat_id, message_id, sum(weight * ((len * 37 % 101) / 100.0::DOUBLE)) / sum(weight) AS positive,
  sum(weight * ((len * 53 % 101) / 100.0::DOUBLE)) / sum(weight) AS negative,
  sum(weight * ((len * 29 % 101) / 100.0::DOUBLE)) / sum(weight) AS neutral FROM n GROUP BY ALL),
c AS (SELECT a.*, greatest(positive, negative, neutral) AS best,
  CASE WHEN positive >= negative AND positive >= neutral THEN 'BULLISH'
       WHEN negative >= neutral THEN 'BEARISH' ELSE 'NEUTRAL' END AS choice FROM a LEFT JOIN s USING (chat_id, message_id))
{_MODEL}"""
)
def model_sentiment_windows(spark, sf):
    """Whole documents of any length before a model that takes 510 tokens."""
    rows = I.prose(spark, sf).select(F.lit(1).cast("long").alias("chat_id"), F.col("doc_id").alias("message_id"), "text")
    scored = scoring.with_scores(analyse.with_flags(rows), _letter_model(), load_tokens=_word_places(), at_once=64)
    return analyse.with_verdict(scored).select(*S.KEY, "sentiment", "confidence")


@query(
    f"""WITH {M}, {Q.annotated('a', 'messages', 'message_id')}
SELECT chat_id, message_id, topic_key FROM a"""
)
def topic_key(spark, sf):
    return analyse.with_flags(I.messages(spark, sf)).select(*S.KEY, "topic_key")


@query(f"WITH {I.PROSE_SQL} SELECT doc_id, {Q.clean(Q.strip('text'))} AS cleaned FROM prose")
def clean_text(spark, sf):
    return I.prose(spark, sf).select(
        "doc_id", keypoints.clean_text(strip(F.col("text"))).alias("cleaned")
    )


@query("SELECT page_id, " + Q.clean("html") + " AS cleaned FROM pages")
def clean_pages(spark, sf):
    return I.table(spark, sf, "pages").select(
        "page_id", keypoints.clean_text(F.col("html")).alias("cleaned")
    )


_CLEANED = f"WITH {I.PROSE_SQL}, c AS (SELECT doc_id, {Q.clean(Q.strip('text'))} AS clean FROM prose)"


def _cleaned(spark, sf):
    return I.prose(spark, sf).select(
        "doc_id", keypoints.clean_text(strip(F.col("text"))).alias("clean")
    )


@query(
    f"""{_CLEANED} SELECT doc_id,
  array_to_string({Q.matches('clean', V.PRICE_PATTERNS, V.PRICE_LENGTHS)}, '|') AS points FROM c"""
)
def price_points(spark, sf):
    return _cleaned(spark, sf).select(
        "doc_id", joined(keypoints.price_points(F.col("clean"))).alias("points")
    )


@query(
    f"""{_CLEANED} SELECT doc_id,
  array_to_string({Q.matches('clean', V.PERFORMANCE_PATTERNS, V.PERFORMANCE_LENGTHS)}, '|') AS points FROM c"""
)
def performance_points(spark, sf):
    return _cleaned(spark, sf).select(
        "doc_id", joined(keypoints.performance_points(F.col("clean"))).alias("points")
    )


@query(
    f"""{_CLEANED}, {Q.catalyst_ctes('c', 'doc_id', 'clean')}
SELECT doc_id, coalesce(array_to_string(points, '|'), '') AS points
FROM c LEFT JOIN catalysts ON k = doc_id"""
)
def catalyst_points(spark, sf):
    return _cleaned(spark, sf).select(
        "doc_id", joined(keypoints.catalyst_points(F.col("clean"))).alias("points")
    )


_FIRST = Q.first_points(
    Q.matches("clean", V.PRICE_PATTERNS, V.PRICE_LENGTHS),
    Q.matches("clean", V.PERFORMANCE_PATTERNS, V.PERFORMANCE_LENGTHS),
    "coalesce(points, [])",
)


@query(
    f"""{_CLEANED}, {Q.catalyst_ctes('c', 'doc_id', 'clean')}
SELECT doc_id, array_to_string({_FIRST}, '|') AS points FROM c LEFT JOIN catalysts ON k = doc_id"""
)
def key_points(spark, sf):
    return _cleaned(spark, sf).select(
        "doc_id", joined(keypoints.text_points(F.col("clean"))).alias("points")
    )


_named = "CASE WHEN len(tokens) > 0 THEN array_to_string(tokens, ', ') ELSE 'crypto tokens' END"
_PROMPT = " || ".join(
    [
        Q.lit(V.PROMPT_HEAD),
        "CASE "
        + f"WHEN len(tokens) > 3 THEN {Q.lit(V.PROMPT_MANY_TOKENS[0])} || {_named} || {Q.lit(V.PROMPT_MANY_TOKENS[1])} "
        + f"WHEN len(tokens) > 1 THEN {Q.lit(V.PROMPT_SOME_TOKENS[0])} || {_named} || {Q.lit(V.PROMPT_SOME_TOKENS[1])} "
        + f"ELSE {Q.lit(V.PROMPT_ONE_TOKEN[0])} || {_named} || {Q.lit(V.PROMPT_ONE_TOKEN[1])} END",
        "CASE keyword " + " ".join(f"WHEN '{k}' THEN {Q.lit(t)}" for k, t in V.PROMPT_SENTIMENT.items()) + " END",
        "chr(10) || chr(10) || 'Message: \"' || @text || '\"'",
        Q.lit(V.PROMPT_RULES),
    ]
)


@query(
    f"""WITH {M}, {Q.annotated('a', 'messages', 'message_id')}
SELECT chat_id, message_id, {_PROMPT.replace('@text', 'text')} AS prompt,
  {_PROMPT.replace('@text', 'substring(text, 1, 400)')} AS short_prompt FROM a WHERE is_investment"""
)
def insight_prompt(spark, sf):
    """With the whole message, and as a model of small context gets it."""
    rows = analyse.with_verdict(
        analyse.with_flags(I.messages(spark, sf).select(*S.KEY, "text")), mode=analyse.LEXICON
    ).where("is_investment")
    parts = F.col("tokens"), F.col("sentiment"), strip(F.col("text"))
    return rows.select(
        *S.KEY,
        keypoints.insight_prompt(*parts).alias("prompt"),
        keypoints.insight_prompt(*parts, V.MODEL_TEXT_CHARS).alias("short_prompt"),
    )


def _replies(spark, sf):
    """Replies with every shape the parser meets, one per event."""
    ev = F.col("event_id")
    props = F.get_json_object("props", "$.k")
    forms = F.array(
        F.concat(F.lit("1. Proven team of "), props, F.lit("\n- CZ backing it\nHere are the insights:\nshort")),
        F.concat(F.lit("* \"Adoption grows by "), props, F.lit("\"\n\n  • Second line here\n+ third line is dropped")),
        F.lit(""),
        F.concat(F.lit("Based on "), props, F.lit("\ntiny\n1) 2) "), F.repeat(F.lit("long "), 20)),
        F.lit(None).cast("string"),
        F.concat(F.lit("  'Market momentum "), props, F.lit("'  \n12. Regulatory clarity improving")),
    )
    return I.table(spark, sf, "events").select(
        (F.col("user_id") % 3 + 1).alias("chat_id"), (ev + 1).alias("message_id"),
        F.element_at(forms, (ev % 6 + 1).cast("int")).alias("reply"),
    )


_k = "json_extract_string(props, '$.k')"
_REPLIES_SQL = f"""replies AS (SELECT user_id % 3 + 1 AS chat_id, event_id + 1 AS message_id,
  [ '1. Proven team of ' || {_k} || chr(10) || '- CZ backing it' || chr(10) || 'Here are the insights:' || chr(10) || 'short',
    '* "Adoption grows by ' || {_k} || '"' || chr(10) || chr(10) || '  • Second line here' || chr(10) || '+ third line is dropped',
    '',
    'Based on ' || {_k} || chr(10) || 'tiny' || chr(10) || '1) 2) ' || repeat('long ', 20),
    NULL,
    '  ''Market momentum ' || {_k} || '''  ' || chr(10) || '12. Regulatory clarity improving'
  ][event_id % 6 + 1] AS reply FROM events)"""
_STOPS = " AND ".join(f"NOT contains(lower(x), {Q.lit(p)})" for p in V.REPLY_STOP_PHRASES)
_REPLY_POINTS = (
    "list_slice(list_filter(list_transform(list_filter(list_transform(list_transform("
    "string_split(coalesce(reply, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), "
    r"lambda x: trim(regexp_replace(x, '^[-•*\d+.)\s]+', ''))), "
    f"lambda x: length(x) BETWEEN 10 AND 80 AND {_STOPS}), "
    "lambda x: trim(x, '\"''')), lambda x: x <> ''), 1, 2)"
)


@query(
    f"""WITH {_REPLIES_SQL} SELECT chat_id, message_id,
  array_to_string({_REPLY_POINTS}, '|') AS points FROM replies"""
)
def insight_reply_points(spark, sf):
    return _replies(spark, sf).select(
        *S.KEY, joined(keypoints.reply_points(F.col("reply"))).alias("points")
    )


@query(
    f"""WITH {M}, {_REPLIES_SQL}, {Q.analysed_ctes()},
p AS (SELECT a.*, {_REPLY_POINTS} AS rp FROM analysed a JOIN replies USING (chat_id, message_id))
SELECT chat_id, message_id, array_to_string(CASE WHEN NOT is_investment THEN [] WHEN len(rp) > 0 THEN rp
  ELSE key_points END, '|') AS points FROM p"""
)
def key_point_choice(spark, sf):
    done = analyse.analyse(
        I.messages(spark, sf), I.at(I.ANALYSED_AT), replies=_replies(spark, sf), mode=analyse.LEXICON
    )
    return done.select(*S.KEY, joined("key_points").alias("points"))


@query(
    f"""WITH {M}, {Q.analysed_ctes()}
SELECT chat_id, message_id, is_investment, sentiment, array_to_string(tokens, '|') AS tokens, topic_key,
  array_to_string(key_points, '|') AS key_points, confidence, 1::INTEGER AS model_version,
  TIMESTAMP '{I.ANALYSED_AT}' AS analyzed_at FROM analysed"""
)
def analyse_all(spark, sf):
    done = analyse.analyse(I.messages(spark, sf), I.at(I.ANALYSED_AT), mode=analyse.LEXICON)
    return done.withColumns(
        {
            "tokens": joined("tokens"), "key_points": joined("key_points"),
            "analyzed_at": I.ntz("analyzed_at"),
        }
    )


def _flags_sql(source: str, keys: str) -> str:
    """Tokens, flag and topic of texts with letters of any script."""
    safe = Q.ascii_words("text")
    return f"""{source}, w AS (SELECT {keys}, text, {safe} AS safe FROM src),
{Q.annotated('a', 'w', keys, text='safe', with_topic=False)}
SELECT {keys}, array_to_string(tokens, '|') AS tokens, is_investment, keyword,
  {Q.topic('tokens', Q.strip('text'))} AS topic_key FROM a"""


def _flags(df, keys):
    rows = analyse.with_verdict(analyse.with_flags(df), mode=analyse.LEXICON)
    low = F.lower("text")
    return rows.select(
        *keys, joined("tokens").alias("tokens"), "is_investment",
        sentiment.keyword_sentiment(sentiment.bullish_score(low), sentiment.bearish_score(low)).alias("keyword"),
        "topic_key",
    )


@query(_flags_sql(f"WITH {I.PROSE_SQL}, src AS (SELECT * FROM prose)", "doc_id"))
def analyse_documents(spark, sf):
    return _flags(I.prose(spark, sf), ["doc_id"])


@query(
    _flags_sql(
        "WITH src AS (SELECT conv_id AS chat_id, turn AS message_id, text FROM conversations)",
        "chat_id, message_id",
    )
)
def analyse_conversations(spark, sf):
    return _flags(I.conversation_messages(spark, sf), S.KEY)

"""Worked-out rows for the text functions."""

import pytest
from pyspark.sql import functions as F

from catalogue.inputs import TEMPLATES
from chatlens.functions import keypoints, ranges, sentiment, tokens
from chatlens.functions.text import strip
from chatlens.operators import analyse, normalise

# text, tokens, investment, sentiment, topic, key points
ROWS = [
    ("Look, $LINK is soaring and the trend is bullish \U0001f680", "LINK", True, "BULLISH", "LINK", ""),
    ("$ADA seems weak today, a dump is near, bearish mood all round", "ADA", True, "BEARISH", "ADA", ""),
    ("Charts are dull, nothing moves. One breakout would help.", "", False, "NEUTRAL", "CHARTS_DULL,_NOTHING", ""),
    ("$UNI and $DOT with strong volume, a defi summer again", "DOT,UNI", True, "BULLISH", "DOT", ""),
    ("Went hiking. Lovely view there! \U0001f60a", "", False, "NEUTRAL", "WENT_HIKING._LOVELY", ""),
    (TEMPLATES[0], "BTC", True, "BULLISH", "BTC", "$BTC to 100K;target $120K"),
    (TEMPLATES[1], "BTC,ETH", True, "BULLISH", "BTC", ""),
    (TEMPLATES[2], "BTC", True, "BEARISH", "BTC", ""),
    (TEMPLATES[3], "", False, "NEUTRAL", "GENERAL", ""),
    (TEMPLATES[4], "", True, "NEUTRAL", "STAKING_THIS_VALIDATOR", ""),
    (TEMPLATES[6], "", False, "NEUTRAL", "RAISED_$10M_$50MIL", ""),
    (TEMPLATES[7], "ETH,SOL", True, "BULLISH", "ETH", "up 60% in january;$SOL flips $ETH"),
    (TEMPLATES[8], "UNI", True, "NEUTRAL", "UNI",
     "token buybacks funded by reve;acks funded by revenue generation for $UNI holde"),
    (TEMPLATES[9], "SOL", True, "NEUTRAL", "SOL",
     "Whale accumulation seen, ETF fili;mulation seen, ETF filing expected for s"),
    (TEMPLATES[10], "DOT,LINK", True, "NEUTRAL", "DOT", ""),
    (TEMPLATES[11], "AVAX", True, "BEARISH", "AVAX", ""),
    (TEMPLATES[12], "", False, "NEUTRAL", "DUMP", ""),
    (TEMPLATES[13], "", True, "NEUTRAL", "PRICE_PRICE_AGAIN", ""),
    (TEMPLATES[14], "BTC", True, "NEUTRAL", "BTC", ""),
    (TEMPLATES[17], "LONGTOKEN1", True, "NEUTRAL", "LONGTOKEN1", ""),
    (TEMPLATES[18], "ADA", True, "BULLISH", "ADA", "bullish on $ADA"),
    (TEMPLATES[19], "LINK", True, "NEUTRAL", "LINK",
     "Chainlink first mover in enterprise;first mover in enterprise contracts"),
    (TEMPLATES[20], "BNB", True, "BEARISH", "BNB", ""),
    (TEMPLATES[21], "AVAX,DOT,MATIC,UNI", True, "BULLISH", "AVAX", ""),
    (TEMPLATES[23], "ARB", True, "BEARISH", "ARB", "mcap 500M MC"),
]


def test_analysis_rows(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(ROWS)], "i int, text string")
    got = analyse.annotate(df, mode=analyse.LEXICON).orderBy("i").collect()
    for row, want in zip(got, ROWS):
        assert (
            row.text, ",".join(row.tokens), row.is_investment, row.sentiment, row.topic_key, ";".join(row.key_points)
        ) == want
        assert row.confidence == (None if not want[2] else 0.6 if want[3] != "NEUTRAL" else 0.0)


def test_strict_mode_stays_neutral(spark):
    df = spark.createDataFrame([("$BTC strong",), ("hello",)], "text string")
    got = {r.text: (r.sentiment, r.confidence) for r in analyse.annotate(df).collect()}
    assert got == {"$BTC strong": ("NEUTRAL", 0.0), "hello": ("NEUTRAL", None)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("$btcé up", []),
        ("bitcoinä", []),
        ("1₿2", ["BTC"]),
        ("x ₿ y", []),
        ("straße $ßab", ["SSAB"]),
        ("$ABCDEFGHIJK", []),
        ("$A", []),
        ("ether Ethereum $eth", ["ETH"]),
        ("　$sol ", ["SOL"]),
    ],
)
def test_token_edges(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert analyse.with_tokens(df).first().tokens == want


@pytest.mark.parametrize(
    "text,hits",
    [
        ("cross-chain bridge", 2), ("Price PRICE pricey", 2), ("taſK", 0), ("gaſ fee", 2),
        ("voté", 1), ("lİstİng", 1), ("bull_run", 0), ("toKen", 1), ("égas", 0),
    ],
)
def test_finance_hits(spark, text, hits):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(tokens.finance_hits(F.col("text")).alias("n")).first().n == hits


def test_families_count_once(spark):
    df = spark.createDataFrame([("moon pump bullish on all-time high; not moonlight",)], "t string")
    row = df.select(
        sentiment.bullish_score(F.col("t")).alias("b"), sentiment.bearish_score(F.col("t")).alias("r")
    ).first()
    assert (row.b, row.r) == (4, 0)


def test_reply_points(spark):
    reply = "1. Proven team\n- CZ backing\nHere are the insights:\nshort"
    df = spark.createDataFrame([(reply,), (None,), ("",)], "r string")
    got = [r.p for r in df.select(keypoints.reply_points(F.col("r")).alias("p")).collect()]
    assert got == [["Proven team", "CZ backing"], [], []]


def test_author_split(spark):
    texts = {
        "alice\n$BTC looks weak but I hold": ("alice", "$BTC looks weak but I hold"),
        "bob smith\nNothing about money here at all": ("bob smith", "Nothing about money here at all"),
        "check http://example.org first\nsecond line of text": (None, "check http://example.org first\nsecond line of text"),
        "  one line  ": (None, "  one line  "),
        "a b c d\nrest": (None, "a b c d\nrest"),
        "\n　eve \n\n  x\ny \n": ("eve", "x\ny"),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.s.author, r.s.text) for r in df.select("t", normalise.author_split(F.col("t")).alias("s")).collect()}
    assert got == texts


@pytest.mark.parametrize(
    "text,start,end",
    [
        ("2024-01-01 to 2024-01-31", "2024-01-01 00:00:00", "2024-01-31 23:59:59"),
        ("2024-01-15 10:30", "2024-01-15 00:00:00", "2024-01-15 23:59:59"),
        ("2024-01-02 10:30 to 1/5", "2024-01-02 10:30:00", "2024-01-05 23:59:59"),
        (" LAST 2W ", "2024-02-16 12:00:00", "2024-03-01 12:00:00"),
        ("last 36h", "2024-02-29 00:00:00", "2024-03-01 12:00:00"),
        ("last 0d", "2024-03-01 12:00:00", "2024-03-01 12:00:00"),
        ("02-29", None, None), ("last h", None, None), ("last 5x", None, None), ("2024-13-01", None, None),
        ("1-1 to 1-2 to 1-3", None, None), ("", None, None), ("last 99999999999d", None, None),
        ("last 999999w", None, None), ("2023-02-29", None, None), ("02-29-2024", "2024-02-29 00:00:00", "2024-02-29 23:59:59"),
    ],
)
def test_ranges(spark, text, start, end):
    df = spark.createDataFrame([(text, "2024-03-01 12:00:00")], "t string, n string")
    r = df.select(ranges.parse_range(F.col("t"), F.col("n").cast("timestamp")).alias("r")).select(
        F.col("r.start_ts").cast("string").alias("a"), F.col("r.end_ts").cast("string").alias("b")
    ).first()
    assert (r.a, r.b) == (start, end)


def test_limits_and_topics(spark):
    limits = {"0": 1, "-4": 1, "limit:20000": 20000, "x": None, "Limit: 7": 7, "": None, "9" * 60: 2**63 - 1, "-" + "9" * 60: 1}
    topics = {"topic:$btc": "BTC", "$$x": "$X", "  ": None, "Topic: eth ": "ETH", "$": None}
    ld = spark.createDataFrame([(k,) for k in limits], "t string")
    td = spark.createDataFrame([(k,) for k in topics], "t string")
    assert {r.t: r.v for r in ld.select("t", ranges.parse_limit(F.col("t")).alias("v")).collect()} == limits
    bounded = {t: v if v is None else min(v, 10000) for t, v in limits.items()}
    cut = ranges.limit_was_cut(F.col("t"), 10000).alias("c")
    rows = ld.select("t", ranges.parse_limit(F.col("t"), 10000).alias("v"), cut).collect()
    assert {r.t: r.v for r in rows} == bounded
    assert {r.t for r in rows if r.c} == {"0", "-4", "limit:20000", "9" * 60, "-" + "9" * 60}
    assert {r.t: r.v for r in td.select("t", ranges.parse_topic(F.col("t")).alias("v")).collect()} == topics


def test_arguments(spark):
    df = spark.createDataFrame([("last 7d topic:eth  limit:5 Topic:sol",), ("2024-01-01 to 2024-01-31",)], "t string")
    got = [tuple(r.p) for r in df.select(ranges.split_arguments(F.col("t")).alias("p")).collect()]
    assert got == [("last 7d", "Topic:sol", "limit:5"), ("2024-01-01 to 2024-01-31", None, None)]


def test_strip_takes_all_unicode_space(spark):
    text = " \x1f a b 　\n"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(strip(F.col("t")).alias("s")).first().s == text.strip()

"""Operators against step-by-step definitions on random small inputs."""

import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogue import inputs as I
from catalogue import report_queries
from chatlens.functions import keypoints
from chatlens.functions import vocabulary as V
from chatlens.operators import normalise, report, requests, token_report, upsert
from chatlens.operators.relational import topic_matches
from chatlens.sources import schemas as S
from chatlens.sources.session import lookup

MESSAGES = T.StructType([*S.MESSAGES.fields, T.StructField("ingest_seq", T.LongType())])


def _arrivals(spark, n_keys=200, seed=3):
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n_keys * 5):
        seq += 1
        # A third of all arrivals belong to one message.
        key = 0 if rng.random() < 0.33 else rng.randrange(n_keys)
        edit = None if rng.random() < 0.5 else rng.randrange(4)
        rows.append((1, key, seq, f"text {seq}", edit, f"user {seq}"))
    rng.shuffle(rows)
    df = spark.createDataFrame(
        rows, "chat_id long, message_id long, ingest_seq long, text string, e long, from_username string"
    )
    return rows, df.select(
        "chat_id", "message_id", "ingest_seq", "text", "from_username",
        F.timestamp_seconds(F.col("e") * 3600).alias("edit_date"),
        F.array("text").alias("urls"),
    )


def _step_by_step(rows):
    table = {}
    for _, key, seq, text, edit, user in sorted(rows, key=lambda r: r[2]):
        if key not in table:
            table[key] = [text, edit, user]
        else:
            stored = table[key][1]
            if stored is None or (edit is not None and stored < edit):
                table[key][:2] = [text, edit]
    return {k: tuple(v) for k, v in table.items()}


def _as_dict(df):
    return {
        r.message_id: (r.text, None if r.e is None else r.e // 3600, r.from_username)
        for r in df.withColumn("e", F.unix_seconds("edit_date")).collect()
    }


def test_fold_equals_one_write_at_a_time(spark):
    rows, df = _arrivals(spark)
    assert _as_dict(upsert.fold_messages(df)) == _step_by_step(rows)


def test_merge_in_batches_equals_one_fold(spark):
    rows, df = _arrivals(spark, seed=11)
    whole = _step_by_step(rows)
    state = upsert.fold_messages(df.where("ingest_seq <= 400"))
    merged = upsert.merge_messages(state, df.where("ingest_seq > 400"))
    assert _as_dict(merged) == whole
    assert _as_dict(upsert.merge_messages(merged, df.where("ingest_seq > 400"))) == whole


def _skip(text, at, char_test):
    while at < len(text) and char_test(text[at]):
        at += 1
    return at


def _phrase_end(text, at, words):
    """Where a phrase of these words ends if it starts at ``at``; None if it does not.

    A word may be a tuple of forms, longest first; white space parts the words.
    """
    for n, forms in enumerate(words):
        if n:
            start, at = at, _skip(text, at, str.isspace)
            if at == start:
                return None
        for form in forms if isinstance(forms, tuple) else (forms,):
            if text[at : at + len(form)].lower() == form:
                at += len(form)
                break
        else:
            return None
    return at


PHRASES = (
    ("buyback", [["token", ("buybacks", "buyback")], [("buybacks", "buyback")]]),
    ("revenue", [["revenue", "generation"]]),
    ("mover", [["first", "mover"]]),
    ("contract", [["enterprise", ("contracts", "contract")]]),
    ("whale", [["whale", "accumulation"]]),
    ("etf", [["etf", ("launch", "filing")]]),
)


def _contexts(text):
    """Every phrase with fifteen characters on both sides, found by walking the text."""
    found = []
    for _, readings in PHRASES:
        at = 0
        while at < len(text):
            ends = [e for e in (_phrase_end(text, at, r) for r in readings) if e is not None]
            if not ends:
                at += 1
                continue
            around = text[:ends[0] + 15][max(0, at - 15):].strip()
            if 10 < len(around) < 50:
                found.append(around)
            at = ends[0]
    return found


def test_catalyst_contexts(spark):
    rng = random.Random(7)
    bits = ["buyback", "Token buybacks", "first mover", "ETF filing", "etf launch", "whale accumulation", "x", " ",
            "\U0001d401\U0001d413", "long filler words here", "revenue  generation", "é", ", "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", keypoints.catalyst_points(F.col("t")).alias("p")).collect()
    for r in got:
        assert r.p == _contexts(texts[r.i]), texts[r.i]


def test_patterns_on_random_unicode_text(spark):
    """Key-point patterns with possessive classes match what plain ones match."""
    rng = random.Random(5)
    bits = ["$BTC", "to", "100K", "target", "$5", "up", "60%", "in", "may", "flips", "ETH", "pumping", "dump", "bullish",
            "on", "500M", "MC", " ", "ſol", "abcdefghij", "٣٣", "is", "outperforms", "btc"]
    texts = [rng.choice([" ", "  ", " "]).join(rng.choice(bits) for _ in range(rng.randrange(1, 20))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    fill = lambda p: p.replace("<space>", r"\s").replace("<digit>", r"\d").replace("<letter>", "[A-Z]").replace("<word>", r"\w")

    def plain(text, patterns, low, high):
        hits = [m.group(0) for p in patterns for m in re.finditer(fill(p), text, re.I)]
        return [h for h in hits if low <= len(h) <= high]

    got = df.select(
        "i", keypoints.price_points(F.col("t")).alias("price"), keypoints.performance_points(F.col("t")).alias("perf")
    ).collect()
    for r in got:
        assert r.price == plain(texts[r.i], V.PRICE_PATTERNS, 6, 29), texts[r.i]
        assert r.perf == plain(texts[r.i], V.PERFORMANCE_PATTERNS, 6, 39), texts[r.i]


def _frame(spark, sf):
    return report_queries.whole_frame(spark, sf).cache()


def test_large_lookup_tables_give_the_same_rows(spark, sf):
    """Joins by shuffle, taken where a lookup table is not small, change nothing."""
    args = I.raw_messages(spark, sf), I.users(spark, sf), I.entities(spark, sf)
    small = normalise.normalise(*args)
    large = normalise.normalise(*args, max_rows=5)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_lookup_keeps_unmatched_and_null_keys(spark):
    facts = spark.createDataFrame([(i, None if i % 3 == 0 else i % 5) for i in range(60)], "id long, k long")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    pick = lambda df: sorted((r.id, str(r.v)) for r in df.collect())
    assert pick(lookup(facts, dim, ["k"])) == pick(lookup(facts, dim, ["k"], max_rows=1))


def test_batch_reports_equal_single_reports(spark, sf):
    frame = _frame(spark, sf)
    parsed = requests.parse(I.requests(spark, sf)).cache()
    for max_rows in (200_000, 1):
        got = {r.request_id: r for r in requests.batch_reports(frame, parsed, max_rows=max_rows).collect()}
        for q in parsed.orderBy("request_id").limit(14).collect():
            row = got[q.request_id]
            if q.error is not None:
                assert row.total_messages == 0 and row.error == "date range"
                continue
            rows = frame.where((F.col("chat_id") == q.chat_id) & F.col("ts_utc").between(q.start_ts, q.end_ts))
            if q.topic:
                rows = rows.where(topic_matches(F.lit(q.topic)))
            if q.row_limit:
                rows = rows.orderBy(F.desc("ts_utc"), F.desc("message_id")).limit(q.row_limit)
            want = report.totals(rows).first()
            assert tuple(row[c] for c in requests.COUNTS) == tuple(want), q
            top = ", ".join(f"{t.token}:{t.n}" for t in report.top_tokens(rows, 5).collect())
            assert row.top_tokens == top, q


def test_empty_report_has_zero_totals(spark, sf):
    rows = report.report_rows(_frame(spark, sf).where("chat_id = -1")).collect()
    assert {(r.section, r.label, r.value, r.pct) for r in rows} == {
        ("summary", "total", 0, None), ("summary", "investment", 0, 0.0),
        ("sentiment", "BULLISH", 0, 0.0), ("sentiment", "BEARISH", 0, 0.0), ("sentiment", "NEUTRAL", 0, 0.0),
    }


def test_more_than_eight_contributors(spark):
    rows = [(1, i, f"2024-01-01 00:00:{i:02d}", f"u{i:02d}" if i else "", True, "BULLISH", ["BTC"], [f"point number {i}"])
            for i in range(12)]
    frame = spark.createDataFrame(
        rows, "chat_id long, message_id long, ts string, from_username string, is_investment boolean, "
              "sentiment string, tokens array<string>, key_points array<string>"
    ).withColumn("ts_utc", F.col("ts").cast("timestamp"))
    r = token_report.token_report(token_report.mentions(frame)).first()
    assert r.contributors == "Unknown, u01, u02, u03, u04, u05, u06, u07 +4 more"
    assert r.bullish_points == [f"point number {i}" for i in (11, 10, 9, 8)]
    assert (r.token, r.mentions, r.no_direction) == ("$BTC", 12, False)

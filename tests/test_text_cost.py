"""Text functions that pass over what cannot match give what the patterns give."""

import random

from pyspark.sql import functions as F
from tests.test_plans import plan_of

from chatlens.functions import keypoints, sentiment, tokens, topics
from chatlens.functions import vocabulary as V
from chatlens.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, SPACE, fill, prefix_tree

PIECES = (
    "$btc", "to", "TO", "$50K", "target", "TARGET", "９", "12", "500M", "MC", "mc", "up", "60%", "in", "ſol", "flıps", "FLIPS", "Keep", "İn",
    "outperforms", "vamping", "bullish", "BULLİSH", "bearish", "on", "$eth", "pumping", "dump", "token", "buybacks", "buybacKs", "revenue",
    "generation", "first", "firſt", "mover", "enterprise", "contracts", "whale", "accumulation", "etf", "ETF", "launch", "filing",
    "https://e.x/a?b=1", "http", "://", "café", "日本", "🚀", "&", "<b>", "BITCOIN", "xBITCOINx", "a₿b", "₿", "SOLANA", "$K", "all-time high", "rally",
)


def test_signs_lose_no_point(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["", " "]) + "".join(rng.choice(PIECES) + rng.choice([" ", " ", "  ", "　", "\n", "", "."]) for _ in range(rng.randrange(9))))
            for i in range(4000)] + [(4000, None)]
    c, none = F.col("t"), F.array().cast("array<string>")
    hits = lambda patterns: F.concat(*[F.regexp_extract_all(c, F.lit(fill(p)), F.lit(0)) for p in patterns])
    within = lambda found, b: F.filter(found, lambda p: F.length(p).between(*b))
    plain = rf"[^a-zA-Z0-9_\p{{L}}\p{{N}}{SPACE[1:-1]}.,!?$%\-]"
    bare = F.regexp_replace(F.regexp_replace(c, V.URL, ""), plain, "")
    names = f"{NOT_AFTER_WORD}{prefix_tree(n for n in tokens._NAMES if n.isalpha())}{NOT_BEFORE_WORD}"
    pairs = (
        (keypoints.price_points(c), within(hits(V.PRICE_PATTERNS), V.PRICE_LENGTHS)),
        (keypoints.performance_points(c), within(hits(V.PERFORMANCE_PATTERNS), V.PERFORMANCE_LENGTHS)),
        (keypoints.catalyst_points(c), keypoints.catalyst_points(c, F.lit(" ".join(x for found in V.CATALYST_SIGNS for x in found)))),
        (keypoints.clean_text(c), bare),
        (F.regexp_extract_all(c, F.lit(tokens.ALIAS), F.lit(0)),
         F.regexp_extract_all(c, F.lit(f"{names}|(?<=[\\w\\p{{L}}\\p{{N}}])₿(?=[\\w\\p{{L}}\\p{{N}}])"), F.lit(0))),
    )
    frame = spark.createDataFrame(rows, "i int, t string").repartition(8)
    for got, want in pairs:
        out = frame.select("t", got.alias("got"), want.alias("want")).where(~F.col("got").eqNullSafe(F.col("want")))
        assert out.take(3) == []
    assert frame.where(F.size(keypoints.price_points(c)) > 0).count() > 20
    assert frame.where(F.size(keypoints.performance_points(c)) > 0).count() > 20
    assert frame.where(keypoints.catalyst_points(c) != none).count() > 20


def test_a_text_is_split_once_for_its_topic(spark):
    rows = spark.createDataFrame([([], "some longer words here"), (["BTC"], "x"), ([], "a b c"), ([], "two words"), (None, "w w"), ([], None)], "k array<string>, t string")
    found = rows.select(topics.topic_key(F.col("k"), F.col("t")).alias("topic"))
    assert [r.topic for r in found.collect()] == ["SOME_LONGER_WORDS", "BTC", "GENERAL", "GENERAL", "GENERAL", "GENERAL"]
    assert plan_of(found).split("Physical Plan")[-1].count("split(") == 1


def test_look_behinds_start_at_first_letters_only():
    for pattern in (tokens.ALIAS, tokens.FINANCE, sentiment.ANY_BULLISH, *sentiment.BEARISH_PATTERNS):
        assert pattern.startswith("(?=[")

"""What the analysis inside the ingest does once, and how tables are dealt to the cores."""

import random

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from tests.test_plans import plan_of

from chatlens.functions import keypoints, sentiment, text, tokens
from chatlens.functions import vocabulary as V
from chatlens.operators import analyse
from chatlens.sources import schemas as S
from chatlens.sources.session import spread
from chatlens.sources.tables import FIRST, LAST, OPEN_FILES, ChatTables

WORDS = [w for f in (*V.BULLISH_FAMILIES, *V.BEARISH_FAMILIES) for w in f if ".?" not in w]
PIECES = [*WORDS, "all-time high", "alltimehigh", "all\ntime high", "all time", "up", "down", "trend", "on", "high", "é", "日", "_", "9", "ſ", "x", "🚀"]


def _texts(spark, pieces, n=6000):
    rng = random.Random(3)
    said = lambda: "".join(rng.choice(pieces) + rng.choice([" ", " ", "\n", "", ".", "-", "　"]) for _ in range(rng.randrange(9)))
    return spark.createDataFrame([(None,), ("",), *[(said(),) for _ in range(n)]], "t string").repartition(8)


def test_families_are_told_by_the_words_of_one_pass(spark):
    low = F.lower("t")
    words = sentiment.family_words(low)
    found = _texts(spark, PIECES).select(
        "t", sentiment.bullish_score(low).alias("bull"), sentiment.bearish_score(low).alias("bear"),
        sentiment.bullish_score(words).alias("bull_told"), sentiment.bearish_score(words).alias("bear_told"),
    )
    assert found.where("bull <> bull_told OR bear <> bear_told OR bull_told IS NULL OR bear_told IS NULL").take(3) == []
    assert found.where("bull > 2 AND bear > 0").count() > 20


def test_the_analysis_seeks_all_families_in_one_pass(spark):
    plan = plan_of(analyse.annotate(_texts(spark, PIECES, 9).withColumnRenamed("t", "text"), mode=analyse.LEXICON))
    assert plan.split("Physical Plan")[-1].count(sentiment.FAMILY_WORD) == 1
    assert "RLIKE(lower(" not in plan.split("Physical Plan")[-1]


def test_word_bounds_and_plain_texts_are_those_of_the_whole_classes(spark):
    marks = ["a", "Z", "9", "_", "é", "日", "٣", " ", "\t", "\x0b", "\xa0", "　", "-", "$", ".", '"', "🚀", "://", "http"]
    c = F.col("t")
    bounds = lambda after, before: F.regexp_extract_all(c, F.lit(f"{after}(?:a|é|-)+{before}"), F.lit(0))
    old = rf"[^a-zA-Z0-9_\p{{L}}\p{{N}}{text.SPACE[1:-1]}.,!?$%\-]"
    pairs = (
        (bounds(text.NOT_AFTER_WORD, text.NOT_BEFORE_WORD), bounds(f"(?<!{text.WORD})", f"(?!{text.WORD})")),
        (keypoints.clean_text(c), F.regexp_replace(F.regexp_replace(c, V.URL, ""), old, "")),
        (text.first_words(c, 3), F.slice(F.split(c, f"{text.SPACE}+", 4), 1, 3)),
    )
    for got, want in pairs:
        assert _texts(spark, marks).where(~got.eqNullSafe(want)).take(3) == []


def test_pieces_smaller_than_a_row_group_leave_no_core_idle(spark, tmp_path):
    path = str(tmp_path / "one_row_group")
    spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("t")).coalesce(1).write.parquet(path)
    size = next((tmp_path / "one_row_group").glob("*.parquet")).stat().st_size
    set_before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // 8)
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 8
        held = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(held(scan)) == 1
        assert sorted(r["count"] for r in held(spread(scan)))[0] > 10_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", set_before)


def test_money_marks_are_told_by_the_cashtag_pattern(spark):
    pieces = ["$MIL", "$BIL", "$TRIL", "$K", "$MILK", "$MIL_", "$BTC", "$ETH", "$BILé", "$", "MIL", "é", "日", "9", "BITCOIN"]
    c = F.col("t")
    money = F.array(*[F.lit(s) for s in V.MONEY_SUFFIXES])
    old = F.array_except(tokens.cashtags(c), money)
    found = _texts(spark, pieces)
    assert found.where(~tokens.asset_cashtags(c).eqNullSafe(old)).take(3) == []
    marked = F.when(F.contains(c, F.lit("$")), old).when(c.isNotNull(), F.array().cast("array<string>"))
    want = F.sort_array(F.array_union(marked, tokens.alias_tokens_if_any(c)))
    assert found.where(~tokens.tokens(c).eqNullSafe(want)).take(3) == []
    assert found.where(F.array_contains(tokens.tokens(c), "MILK") & c.contains("$MIL ")).count() > 5
    assert "array_except" not in plan_of(found.select(tokens.tokens(c)))


def _messages(spark, days=40):
    rows = spark.range(days * 6).select(
        (F.col("id") % 2 + 1).alias("chat_id"), (F.col("id") % (days * 2)).alias("message_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("id") % days).cast("int"))).alias("ts_utc"),
        F.concat(F.lit("$BTC "), F.col("id").cast("string")).alias("text"), F.col("id").alias("ingest_seq"),
    )
    return S.with_message_defaults(S.conform(rows, S.T.StructType([*S.MESSAGES.fields, S.T.StructField("ingest_seq", S.T.LongType())])), F.current_timestamp())


def test_a_merge_keeps_the_files_of_its_folders_open(spark, tmp_path, monkeypatch):
    tables, seen, real = ChatTables(spark, str(tmp_path / "t")), [], DataFrameWriter.parquet

    def write(self, *args, **more):
        seen.append(spark.conf.get(OPEN_FILES))
        return real(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", write)
    before = spark.conf.get(OPEN_FILES)
    # 80 folders, more than stay open at once
    tables.merge("messages", _messages(spark).coalesce(1))
    assert seen == ["16"] and spark.conf.get(OPEN_FILES) == before
    assert tables.stored("messages").count() == 240
    assert tables.stored("messages").where(F.col("day") != F.to_date("ts_utc")).count() == 0


def test_readers_do_not_carry_the_places_of_arrivals(spark, tmp_path):
    tables = ChatTables(spark, str(tmp_path / "t"))
    tables.merge("messages", _messages(spark))
    tables.merge("messages", _messages(spark).where("message_id % 3 = 0"))
    whole = tables._fold("messages", tables.stored("messages"))
    state = tables.state("messages")
    assert set(whole.columns) - set(state.columns) == {*FIRST, *LAST}
    assert sorted(whole.select(*state.columns).collect(), key=str) == sorted(state.collect(), key=str)
    carried = [a.split(")")[0] for a in state._jdf.queryExecution().analyzed().toString().replace("struct(", "\0").split("\0")[1:]]
    values = [a for a in carried if "text" in a or "from_username" in a]
    assert values and not any(place in a for a in values for place in (*FIRST, *LAST))

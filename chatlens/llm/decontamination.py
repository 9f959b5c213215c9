"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Every benchmark item is cut into windows of ten words (a shorter item is one
window). A window is a set of shingles; a text that holds the window holds all
of them, so it is enough to look for the one that is rarest in the documents:
the prefix of the window in the order of rarity. Where that shingle stands, the
place of the window follows from the shingle's offset; it must lie within the
text, and the words there must equal those of the window.

The documents are read once for the counts and once for the places, whatever the
size of the benchmark. Windows shorter than a shingle are sought apart, by all
their words, so that they don't make the shingles of the others shorter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm import common

WINDOW = 10
SHINGLE = 2
#: What stands between words: runs of ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Tokens up to which they are broadcast themselves; more go as a bit map of fixed size.
MAX_TOKENS = 2_000_000
#: Words of 64 bits of that bit map.
MAP_SLOTS = 1 << 20
#: Prefixes (five numbers each) up to which they are broadcast; more are joined by a shuffle.
MAX_PREFIXES = 200_000


def words(text: Column) -> Column:
    """Words of a text. Splitting is linear; extracting all matches copies the text for each of them."""
    parts = F.split(F.translate(text, _UPPER, _UPPER.lower()), BETWEEN)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _exploded(rows: DataFrame, kept: list[str], k: int) -> DataFrame:
    """A row for each word: its place and the hash of the shingle that starts there."""
    named = rows.select(*kept, *[F.slice("words", F.lit(i + 1), F.greatest(F.size("words"), F.lit(1))).alias(f"w{i}") for i in range(k)])
    parts = F.arrays_zip(*[F.col(f"w{i}") for i in range(k)])
    return named.select(*kept, F.posexplode(parts).alias("pos", "_s")).select(
        *kept, "pos", F.xxhash64(*[F.col("_s")[f"w{i}"] for i in range(k)]).alias("token")
    )


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(win array<string>, items array<string>)``: the distinct windows and the items that have them."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    each = w.select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(window)).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("items"))


def _tokens(docs: DataFrame, kept: list[str], k: int, wanted: DataFrame) -> DataFrame:
    """``kept, pos, token`` of the places whose token is wanted, and of few others.

    Up to ``MAX_TOKENS`` wanted tokens are broadcast. More of them are known by one
    bit each in a map of ``MAP_SLOTS`` words, which lets a few others pass.
    """
    places = _exploded(docs, kept, k)
    if wanted.limit(MAX_TOKENS + 1).count() <= MAX_TOKENS:
        return places.join(F.broadcast(wanted), "token", "left_semi")
    slot, bit = F.pmod("token", F.lit(MAP_SLOTS)), "cast(shiftright(token, 32) & 63 AS int)"
    bits = wanted.groupBy(slot.alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("bits"))
    found = places.withColumn("slot", slot).join(F.broadcast(bits), "slot")  # at most MAP_SLOTS rows
    return found.where(F.getbit("bits", F.expr(bit)) == 1).select(*kept, "pos", "token")


def _found(docs: DataFrame, wins: DataFrame, keys: list[str], k: int, window: int) -> DataFrame:
    """``keys, start, length, items`` of every occurrence of windows of ``k`` words or more."""
    # of a window's shingles only those that lie wholly inside it
    inside = _exploded(wins.withColumn("words", F.col("win")), ["id", "win"], k).where(F.col("pos") <= F.size("win") - k)
    inside = inside.select("id", "token", "pos", F.size("win").alias("length"), F.xxhash64("win").alias("hash"))
    # a window with a shingle that no document holds has no occurrence: the left join puts that shingle first
    rarity = _tokens(docs, [], k, inside.select("token").distinct()).groupBy("token").agg(F.count("*").alias("n"))
    rare = F.min_by(F.struct("token", "pos"), F.struct(F.coalesce("n", F.lit(0)), "token", "pos")).alias("rare")
    ranked = inside.join(rarity, "token", "left").groupBy("id", "length", "hash").agg(rare)
    prefix = common.table(ranked.select("rare.token", F.col("rare.pos").alias("offset"), "length", "hash", "id"), "prefixes")
    places = _tokens(docs.select(*keys, "words"), [*keys, "words"], k, prefix.select("token").distinct())
    # the words that a window with its prefix here may have, so that texts need not be moved
    low = F.greatest(F.col("pos") - (window - k), F.lit(0))
    near = places.select(*keys, "token", "pos", low.alias("low"), F.slice("words", low + 1, F.col("pos") + window - low).alias("near"))
    start = F.col("pos") - F.col("offset")
    candidates = (
        near.join(common.small_or_whole(prefix, MAX_PREFIXES), "token")
        .withColumn("start", start)
        .where((F.col("start") >= 0) & (F.col("start") - F.col("low") + F.col("length") <= F.size("near")))
        .withColumn("found", F.slice("near", F.greatest(F.col("start") - F.col("low"), F.lit(0)) + 1, F.col("length")))  # filters come in any order
        .where(F.xxhash64("found") == F.col("hash"))
        .select(*keys, "start", "length", "id", "found")
    )
    return candidates.join(wins, "id").where(F.col("found") == F.col("win")).select(*keys, "start", "length", "items")


def matches(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame | None:
    """``keys, start, length, items`` of every occurrence; None if the benchmark has no window.

    ``docs`` has ``keys`` and ``words``. What the tasks get whole has a bound in
    bytes that the benchmark doesn't move; words and items of a window are joined
    last, to what its hash has confirmed.
    """
    wins = common.table(windows(benchmark, window).withColumn("id", F.monotonically_increasing_id()), "windows")
    sizes = [r.n for r in wins.groupBy(F.least(F.size("win"), F.lit(shingle)).alias("n")).count().collect()]  # at most ``shingle``
    found = [_found(docs, wins.where(F.least(F.size("win"), F.lit(shingle)) == k), keys, k, window) for k in sorted(sizes)]
    return reduce(DataFrame.union, found) if found else None


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str], window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame | None:
    """``keys, n_hit, n_items, items_sha256`` of each text with an occurrence.

    A text is known by ``keys``; rows with equal keys must have equal texts and
    count once. What is gathered for a text is bounded by its length and by the
    number of items.
    """
    found = matches(docs, benchmark, keys, window, shingle)
    if found is None:
        return None
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    gathered = found.groupBy(*keys).agg(spans.alias("spans"), F.collect_set("items").alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"].cast("long")), F.lit(0).cast("long"))).alias("n"),
            F.greatest(acc["end"], (s["start"] + s["length"]).cast("long")).alias("end"),
        ),
    )
    ids = F.array_sort(F.array_distinct(F.flatten("items")))
    return gathered.select(
        *keys, covered["n"].alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """A text is known by its document and its content, so repeated ids and rows do no harm."""
    return docs.withColumn("_th", F.xxhash64("text")).withColumn("_len", F.length("text"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every document.

    Null and empty texts have no words; null items and items without words have
    no window; item ids are compared as strings and a null id is left out of the
    list. Repeated rows each get the same result. An empty benchmark hits nothing.
    """
    rows = _keyed(docs.select("doc_id", "text"))
    keys = ["doc_id", "_th", "_len"]
    texts = rows.select(*keys, words(F.col("text")).alias("words"))
    found = hits(texts, benchmark, keys, window, shingle)
    own = texts.select(*keys, F.size("words").cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if found is None:
        return own.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
                          none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    found = found.select(*[F.col(k).alias(f"k_{k}") for k in keys], "n_hit", "n_items", "items_sha256")
    same = reduce(lambda a, b: a & b, [own[k].eqNullSafe(found[f"k_{k}"]) for k in keys])
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return own.join(found, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents in which no window occurs, all columns kept."""
    keys = [common.fresh(docs, k) for k in ("_did", "_th", "_len")]
    rows = docs.withColumns(dict(zip(keys, (F.col("doc_id"), F.xxhash64("text"), F.length("text")))))
    found = hits(rows.select(*keys, words(F.col("text")).alias("words")), benchmark, keys, window, shingle)
    if found is None:
        return docs
    found = found.select(*[F.col(k).alias(f"k{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(found[f"k{k}"]) for k in keys])
    return rows.join(found, same, "left_anti").select(*docs.columns)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), place AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), hit AS (
  SELECT DISTINCT r, i, place.n AS n, item_id FROM place JOIN win USING (t, n)
), pos AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)
"""

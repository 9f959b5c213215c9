"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm import common

SHARDS = 40
SEED = "shard-1"
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def interleaved(rows: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Give every row a ``shard`` and its ``slot`` there. ``rows`` has ``doc_id, source``.

    The rows of each source are shuffled by a seeded draw and ranked; row k of n
    has the fractional rank (k - 1/2) / n. In the order of that fraction all
    sources run side by side in proportion, so any cut of equal length matches
    the whole mixture to about one row of each source. The cuts make the counts
    of shards differ by at most one.

    A null source is a source of its own, a null ``doc_id`` one more value.
    Repeated rows are placed one by one; which of two equal rows gets which
    place is open. With fewer rows than shards some shards stay empty. Both
    ranks come from range partitions, so a source with a third of all rows is
    sorted by a third of the tasks. Columns ``shard`` and ``slot`` are replaced,
    all others kept.
    """
    rows = rows.drop("shard", "slot")
    draw, k, of, n_of, at, place = (common.fresh(rows, c) for c in ("_draw", "_k", "_source", "_n", "_at", "_spot"))
    drawn = rows.withColumn(draw, F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))))
    last = F.col("source").asc_nulls_last()
    by_draw = [F.col(draw), F.col("doc_id").asc_nulls_last()]
    placed = common.ranked(drawn, [last, *by_draw], "source", k).drop(draw)
    totals = common.small_or_whole(placed.groupBy(F.col("source").alias(of)).agg(F.count("*").alias(n_of)))
    whole = placed.join(totals, placed["source"].eqNullSafe(totals[of])).drop(of)
    lined = whole.withColumn(at, (2 * F.col(k) + 1) / (2 * F.col(n_of)).cast("double")).drop(k, n_of)
    # a row is known by fraction and source; equal rows only differ by their place
    spot = common.ranked(lined, [F.col(at), last, F.col("doc_id").asc_nulls_last()], None, place).drop(at)
    n = max(spot.count(), 1)
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return (
        spot.withColumn("shard", F.expr(f"({place} * {shards}) div {n}L").cast("int"))
        .withColumn("slot", (F.col(place) - first).cast("long"))
        .drop(place)
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Documents with ``shard`` and ``slot``; texts move once, the sorts see ids only."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rid = common.fresh(docs, "_rid")
    rows = common.table(docs.select(*kept).withColumn(rid, F.monotonically_increasing_id()), "shards")
    spots = interleaved(rows.select(rid, "doc_id", "source"), shards, seed)
    of = common.fresh(rows, "_of")
    spots = spots.select(F.col(rid).alias(of), "shard", "slot")
    return rows.join(spots, rows[rid] == spots[of]).select(*kept, "shard", "slot")


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.col("text")
    rows = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return interleaved(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_CRC_TABLE = """
t AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) r(i)))"""

OP3_SQL = f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, source, text, coalesce(strlen(text), 0) + 16 AS size FROM documents
), a AS (
  SELECT doc_id, source, size, text,
         row_number() OVER (PARTITION BY source ORDER BY md5('shard-1|' || doc_id), doc_id) - 1 AS k,
         count(*) OVER (PARTITION BY source) AS n
  FROM d
), b AS (
  SELECT *, row_number() OVER (ORDER BY (2 * k + 1)::DOUBLE / (2 * n)::DOUBLE, source NULLS LAST, doc_id) - 1 AS spot,
         count(*) OVER () AS total
  FROM a
)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(text), '..'), lambda h: ('0x' || h)::BIGINT)),
           lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295)::BIGINT AS text_crc32,
       'rows' AS law, (spot * 40 // total)::INTEGER AS shard,
       (spot - ((spot * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM b, t
"""

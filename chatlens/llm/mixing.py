"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatlens.llm import common

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2.0
SEED = "mix-1"


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its parts only (28 bits of an MD5)."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING
) -> DataFrame:
    """Targets from one row ``(source, source_size)`` for each source.

    Sources in code point order, null last, take the weights in turn and divide
    ``share`` of all sizes. No target exceeds ``ceiling`` times its source; what
    is cut off goes to the others by weight. That has a closed form: with the
    sources in the order of ``ceiling * size / weight`` a run of first ones is
    full, and the rest share what is left at one level. The frame has a row for
    each source, so the global windows see sources, never documents.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1
    weighed = (
        sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(ceiling)))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
    )
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "_at",
        (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0)))
        / F.sum("_w").over(onward),
    )
    # the level of the first source that it does not fill; null: all are full
    level = F.min(F.when(F.col("_at") <= F.col("_level"), F.struct("_level", "_at"))).over(every)["_at"]
    target = F.when(level.isNull() | (F.col("_level") <= level), F.col("_cap")).otherwise(F.col("_w") * level)
    return levels.select("source", "source_size", target.alias("target"))


def copies(rows: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """How often each row enters the mix. ``rows`` has ``doc_id, source, size``.

    Adds ``source_size, target, copies, taken``. Each document of a source
    expects ``target / source_size`` copies. In the order of falling size (ties
    in an order drawn from the seed) the expected copies are summed up; one
    offset for each source is added, and a document enters once for each integer
    that its part of the sum crosses. As sizes fall along the sum, the words
    taken differ from the target by less than the largest document.

    Nulls: a null source is a source of its own; a null ``doc_id`` is one more
    value. Repeated rows are sampled one by one. Size 0 is never over the limit
    and takes no words. An empty frame gives an empty frame. Other columns of
    ``rows`` are kept; those with the names of added ones are replaced.
    """
    rows = rows.drop("source_size", "target", "copies", "taken")
    # the draw decides the order of equal sizes, so runs over other file layouts agree
    tie = common.fresh(rows, "_tie")
    drawn = rows.withColumn(tie, F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))))
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col(tie), F.col("doc_id").asc_nulls_last()]
    rank, name = common.fresh(rows, "_rank"), common.fresh(rows, "_source")
    placed = common.ranked(drawn, order, "source", rank).drop(tie)
    found = source_targets(placed.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), **targets)
    goal = common.small_or_whole(found.select(F.col("source").alias(name), "source_size", "target"))
    out = placed.join(goal, placed["source"].eqNullSafe(goal[name])).drop(name)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_draw(F.lit(seed), F.coalesce(F.col("source"), F.lit("\x00")))
    upper = F.floor(offset + rate * (F.col(rank) + 1).cast("double"))
    lower = F.floor(offset + rate * F.col(rank).cast("double"))
    return (
        out.withColumn("copies", (upper - lower).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(rank)
    )


def mix(docs: DataFrame, seed: str = SEED, **targets) -> DataFrame:
    """The documents of the mix, each as often as it was drawn, with their own columns.

    The rows are numbered in a table in the shared folder, so that repeated rows
    stay apart; only id, source and word count are sorted, and texts move once.
    """
    rid = common.fresh(docs, "_rid")
    rows = common.table(docs.withColumn(rid, F.monotonically_increasing_id()), "mix")
    narrow = rows.select(rid, "doc_id", "source", common.word_count(F.col("text")).alias("size"))
    of, times, copy = (common.fresh(rows, c) for c in ("_of", "_copies", "_copy"))
    taken = copies(narrow, seed, **targets).where("copies > 0").select(F.col(rid).alias(of), F.col("copies").alias(times))
    out = rows.join(taken, rows[rid] == taken[of])
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    return copies(rows).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS lev FROM s
), a AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY lev, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY lev, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_level
  FROM l
), g AS (
  SELECT *, (SELECT arg_min(at_level, lev) FROM a WHERE at_level <= lev) AS level FROM a
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR lev <= level THEN cap ELSE w * level END AS target FROM g
), r AS (
  SELECT doc_id, source, size,
         row_number() OVER (PARTITION BY source ORDER BY size DESC, md5('mix-1|' || doc_id), doc_id) - 1 AS k
  FROM d
), c AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.k,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || md5('mix-1|' || coalesce(r.source, chr(0)))[:7])::BIGINT::DOUBLE / 268435456::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * (k + 1)::DOUBLE) - floor(u + rate * k::DOUBLE)) * size)::BIGINT AS taken
FROM c
"""

"""Declared constraints as one validation job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.vocabulary import SENTIMENTS
from chatlens.sources import schemas as S


def _any_null(schema) -> Column:
    bad = F.lit(False)
    for f in schema.fields:
        if not f.nullable:
            bad = bad | F.col(f.name).isNull()
    return bad.cast("int")


def constraint_report(messages: DataFrame, analysis: DataFrame) -> DataFrame:
    """Rows (check, violations) for not-null, key, domain and reference rules.

    Both tables are reduced to key and flags, united, and grouped by key once:
    uniqueness and the reference need no join, and repeated keys shrink before
    the shuffle.
    """
    zero = F.lit(0)
    sides = messages.select(
        *S.KEY, F.lit(1).alias("m"), zero.alias("a"),
        _any_null(S.MESSAGES).alias("m_null"), zero.alias("a_null"), zero.alias("a_domain"),
    ).unionByName(
        analysis.select(
            *S.KEY, zero.alias("m"), F.lit(1).alias("a"), zero.alias("m_null"),
            _any_null(S.ANALYSIS).alias("a_null"),
            F.coalesce(~F.col("sentiment").isin(*SENTIMENTS), F.lit(False)).cast("int").alias("a_domain"),
        )
    )
    per_key = sides.groupBy(*S.KEY).agg(
        *[F.sum(c).alias(c) for c in ("m", "a", "m_null", "a_null", "a_domain")]
    )
    found = per_key.agg(
        F.sum("m_null").alias("messages_not_null"),
        F.count_if(F.col("m") > 1).alias("messages_primary_key"),
        F.sum("a_null").alias("analysis_not_null"),
        F.count_if(F.col("a") > 1).alias("analysis_primary_key"),
        F.sum("a_domain").alias("analysis_sentiment"),
        F.sum(F.when(F.col("m") == 0, F.col("a")).otherwise(zero)).alias("analysis_reference"),
    )
    return found.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("check"), F.coalesce(c, zero).cast("long").alias("violations"))
                    for c in found.columns
                ]
            )
        )
    )

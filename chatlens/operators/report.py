"""Aggregates of the standard report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.functions import vocabulary as V
from chatlens.operators.relational import newest_first


def percent(part: Column, base: Column) -> Column:
    """Percentage with one decimal, ties to even; zero where there is no base."""
    return F.when(base > 0, F.bround(part / base * 100, 1)).otherwise(F.lit(0.0))


def _sentiment_count(label: str) -> Column:
    return F.count_if(F.col("is_investment") & (F.col("sentiment") == label))


def totals(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages, investment messages and their sentiments, per group or overall."""
    return frame.groupBy(*(by or [])).agg(
        F.count("*").alias("total_messages"),
        F.count_if("is_investment").alias("investment_messages"),
        *[_sentiment_count(s).alias(s.lower()) for s in V.SENTIMENTS],
    )


def sentiment_breakdown(frame: DataFrame) -> DataFrame:
    """One row per sentiment, zeros included: one aggregate row turned on its side."""
    wide = totals(frame)
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("sentiment"), F.col(s.lower()).alias("n"))
                    for s in V.SENTIMENTS
                ]
            )
        ),
        "investment_messages",
    ).select(
        "sentiment", "n", percent(F.col("n"), F.col("investment_messages")).alias("pct")
    )


def mention_counts(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages per token, with where the token was last seen.

    All aggregates combine on the map side, so a token found in most messages
    sends one row per task.
    """
    keys = by or []
    seen = frame.select(
        *keys, "ts_utc", "message_id", F.posexplode("tokens").alias("pos", "token")
    )
    return seen.groupBy(*keys, "token").agg(
        F.count("*").alias("n"),
        F.max(F.struct("ts_utc", "message_id", (-F.col("pos")).alias("pos"))).alias("last_seen"),
    )


def by_mentions() -> list[Column]:
    """Most mentioned first; ties as they appear in the newest messages."""
    return [F.col("n").desc(), F.col("last_seen").desc()]


def top_tokens(frame: DataFrame, k: int = V.TOP_TOKENS) -> DataFrame:
    return mention_counts(frame).orderBy(*by_mentions()).limit(k).select("token", "n")


def report_rows(frame: DataFrame, shown_tokens: int = V.SHOWN_TOKENS) -> DataFrame:
    """The whole report as rows (section, rank, label, value, pct).

    One pass over the frame: messages are exploded to their tokens once, the
    first row of a message also carries its share of the totals, and a single
    shuffle of partial counts per token feeds all sections.
    """
    first = F.col("pos").isNull() | (F.col("pos") == 0)
    invested = first & F.col("is_investment")
    per_token = (
        frame.select(
            "ts_utc", "message_id", "is_investment", "sentiment",
            F.posexplode_outer("tokens").alias("pos", "token"),
        )
        .groupBy("token")
        .agg(
            F.count("token").alias("n"),
            F.max(F.struct("ts_utc", "message_id", (-F.col("pos")).alias("pos"))).alias("last_seen"),
            F.count_if(first).alias("total"),
            F.count_if(invested).alias("investment"),
            *[F.count_if(invested & (F.col("sentiment") == s)).alias(s) for s in V.SENTIMENTS],
        )
    )
    sums = ["total", "investment", *V.SENTIMENTS]
    # Long form: each token row yields its own count and its shares of the totals.
    long = per_token.select(
        "n", "last_seen", "token",
        F.explode(
            F.array(
                F.struct(
                    F.lit("token").alias("kind"), F.col("token").alias("label"),
                    F.col("n").alias("part"),
                ),
                *[
                    F.struct(F.lit("sum").alias("kind"), F.lit(c).alias("label"), F.col(c).alias("part"))
                    for c in sums
                ],
            )
        ).alias("e"),
    ).select("e.kind", "e.label", "e.part", "last_seen")
    # Zero rows keep the sums in the report when the frame is empty.
    zeros = frame.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit("sum").alias("kind"), F.lit(c).alias("label"), F.lit(0).cast("long").alias("part"))
                    for c in sums
                ]
            )
        )
    ).withColumn("last_seen", F.lit(None).cast(long.schema["last_seen"].dataType))
    gathered = (
        long.unionByName(zeros).where((F.col("kind") == "sum") | F.col("label").isNotNull())
        .groupBy("kind", "label")
        .agg(F.sum("part").alias("n"), F.max("last_seen").alias("last_seen"))
    )
    # At most five sums, so the same rank test keeps them all while it cuts
    # tokens to the leading few on the map side.
    keep = max(shown_tokens, len(sums))
    ranked = gathered.withColumn(
        "rank", F.row_number().over(Window.partitionBy("kind").orderBy(*by_mentions(), "label"))
    ).where(F.col("rank") <= keep)
    few = ranked.where((F.col("kind") == "sum") | (F.col("rank") <= shown_tokens))
    whole = Window.partitionBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )

    def value_of(label: str) -> Column:
        is_it = (F.col("kind") == "sum") & (F.col("label") == label)
        return F.max(F.when(is_it, F.col("n"))).over(whole)

    order = {"total": 1, "investment": 2, **{s: i + 1 for i, s in enumerate(V.SENTIMENTS)}}
    fixed_rank = F.lit(None).cast("int")
    for label, place in order.items():
        fixed_rank = F.when(F.col("label") == label, place).otherwise(fixed_rank)
    is_token = F.col("kind") == "token"
    return (
        few.withColumns({"_total": value_of("total"), "_investment": value_of("investment")})
        .select(
            F.when(is_token, "tokens")
            .when(F.col("label").isin("total", "investment"), "summary")
            .otherwise("sentiment")
            .alias("section"),
            F.when(is_token, F.col("rank")).otherwise(fixed_rank).alias("rank"),
            "label",
            F.col("n").alias("value"),
            F.when(is_token | (F.col("label") == "total"), F.lit(None).cast("double"))
            .when(F.col("label") == "investment", percent(F.col("n"), F.col("_total")))
            .otherwise(percent(F.col("n"), F.col("_investment")))
            .alias("pct"),
        )
    )


def previews(
    frame: DataFrame, by: list[str], rows: int | None = V.PREVIEW_ROWS, only_up_to: int | None = None,
    chars: int | None = V.PREVIEW_CHARS, tokens: int | None = V.PREVIEW_TOKENS,
) -> DataFrame:
    """Newest ``rows`` of every group: time, author, ``chars`` of the text, ``tokens`` of its tokens (None: all).

    With ``only_up_to`` groups of more messages get no preview. Rank tests decide
    both on the map side, so a huge group never meets in one task.
    """
    newest_window = Window.partitionBy(*by).orderBy(*newest_first())
    head = frame.withColumn("rank", F.row_number().over(newest_window))
    if only_up_to is not None:
        head = head.where(F.col("rank") <= max(only_up_to + 1, rows or 0))
        size = F.count("*").over(Window.partitionBy(*by))
        head = head.withColumn("_size", size).where(F.col("_size") <= only_up_to)
    if rows is not None:
        head = head.where(F.col("rank") <= rows)
    short = F.col("text") if chars is None else F.when(
        F.length("text") > chars, F.concat(F.substring("text", 1, chars), F.lit("..."))
    ).otherwise(F.col("text"))
    named = F.col("tokens") if tokens is None else F.slice("tokens", 1, tokens)
    marks = F.array_join(F.transform(named, lambda t: F.concat(F.lit("$"), t)), ", ")
    return head.select(
        *by,
        "rank",
        F.date_format("ts_utc", "MM-dd HH:mm").alias("at"),
        F.coalesce("from_username", F.lit("Unknown")).alias("author"),
        "sentiment",
        marks.alias("marks"),
        short.alias("preview"),
    )

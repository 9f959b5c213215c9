"""Re-reading recent or given stretches of the source, and re-analysis after edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.functions.vocabulary import MODEL_VERSION, OVERLAP_MINUTES
from chatlens.operators import analyse, relational, upsert
from chatlens.sources import scans
from chatlens.sources import schemas as S
from chatlens.sources.tables import BUCKET, DAY, EDIT_DAY, REDONE, ChatTables, as_column, between_days
from chatlens.streaming import live


def overlap_window(arrivals: DataFrame, now: Column, minutes: int = OVERLAP_MINUTES) -> DataFrame:
    """Source rows of the last ``minutes``; all of them, without a row cap."""
    start = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0.0))
    return arrivals.where(F.col("ts_utc").between(start, now) & (F.length("text") > 0))


def rescan_range(
    stored: DataFrame, stored_analysis: DataFrame, arrivals: DataFrame, start, end,
    analyzed_at: Column, mode: str = analyse.STRICT,
) -> tuple[DataFrame, DataFrame]:
    """Messages and analysis after re-reading start..end of the source."""
    again = scans.by_time(arrivals, start, end)
    messages = upsert.merge_messages(stored, again)
    last = upsert.fold_latest(again.select(*S.KEY, "text", upsert.SEQ))
    fresh = analyse.analyse(last, analyzed_at, mode=mode)
    analysis = upsert.merge_latest(
        stored_analysis, fresh.withColumn(upsert.SEQ, F.lit(0).cast("long"))
    )
    return messages, analysis


def reanalyse_edited(
    messages: DataFrame, analysis: DataFrame, analyzed_at: Column, mode: str = analyse.STRICT
) -> DataFrame:
    """Analysis table with edited messages analysed anew where it was out of date."""
    stale = relational.needs_reanalysis(messages, analysis).select(*S.KEY)
    texts = messages.select(*S.KEY, "text").join(stale, S.KEY, "left_semi")
    fresh = analyse.analyse(texts, analyzed_at, mode=mode)
    return upsert.merge_latest(analysis, fresh.withColumn(upsert.SEQ, F.lit(0).cast("long")))


def stale(tables: ChatTables, start, end, edited_since=None) -> DataFrame:
    """Messages edited since their analysis: key, text, edit and ``day``.

    Looked for among those of ``start`` to ``end``, and with ``edited_since``
    also among all that were edited from then on. These are found by the day of
    the edit: the edits table names the partitions that hold them, and those
    choose the folders of messages and analysis that are opened at all.
    """
    span = F.col("ts_utc").between(as_column(start), as_column(end))
    wanted = [*S.KEY, "text", "edit_date", DAY]
    in_days = between_days(start, end)
    messages = tables.state("messages", in_days).where(span).select(*wanted)
    found = _outdated(messages, tables.state("analysis", in_days))
    if edited_since is None:
        return found
    edits = tables.state("edits", between_days(edited_since, column=EDIT_DAY)).where(F.col("edit_date") >= as_column(edited_since))
    parts = edits.select(BUCKET, DAY).distinct()
    keys = edits.select(*S.KEY).distinct()
    older = tables.state("messages", only=parts).where(~span).select(*wanted).join(keys, S.KEY, "left_semi")
    return found.unionByName(_outdated(older, tables.state("analysis", only=parts)))


def _outdated(messages: DataFrame, analysis: DataFrame) -> DataFrame:
    keys = relational.needs_reanalysis(messages, analysis).select(*S.KEY)
    return messages.select(*S.KEY, "text", "edit_date", DAY).join(keys, S.KEY, "left_semi")


def rescan_tables(
    tables: ChatTables, arrivals: DataFrame, start, end, analyzed_at: Column,
    mode: str = analyse.STRICT, edited_since=None,
) -> None:
    """Re-read start..end of the source into stored tables, then re-analyse edits
    (see ``stale``)."""
    live.write_batch(tables, scans.by_time(arrivals, start, end), None, analyzed_at, mode)
    fresh = analyse.annotate(stale(tables, start, end, edited_since), mode=mode).withColumns(
        {"model_version": F.lit(MODEL_VERSION), "analyzed_at": analyzed_at, REDONE: F.lit(True)}
    )
    tables.merge("analysis", fresh)


def overlap_rescan(
    tables: ChatTables, arrivals: DataFrame, now: Column, analyzed_at: Column,
    minutes: int = OVERLAP_MINUTES, mode: str = analyse.STRICT,
) -> None:
    """The step that a running ingest takes now and then: re-read the last
    ``minutes`` and re-analyse what was edited in them, however old it is."""
    start = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes), F.lit(0.0))
    rescan_tables(tables, arrivals, start, now, analyzed_at, mode, edited_since=start)

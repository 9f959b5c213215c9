"""Ingest statistics as one row, measured from what the ingest stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.sources import schemas as S
from chatlens.sources.tables import ChatTables


def ingest_stats(tables: ChatTables, now: Column) -> DataFrame:
    """Rows read and set aside, messages and analyses held, re-scans, and the lag
    in seconds of the least advanced chat.

    One-row aggregates, stacked and folded into one row.
    """
    zero = F.lit(0).cast("long")
    parts = [
        tables.notes().agg(
            F.sum("rows_read").alias("rows_read"), F.sum("rows_bad").alias("rows_bad"),
            F.count_if("rescan").alias("rescans"),
        ),
        *[tables.stored(name).select(*S.KEY).distinct().agg(F.count("*").alias(held))
          for name, held in (("messages", "messages_ingested"), ("analysis", "messages_analysed"))],
        tables.current("ingest_checkpoint").agg(
            (F.unix_micros(now) - F.unix_micros(F.min("last_ts_utc"))).alias("lag")
        ),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    total = lambda c: F.coalesce(F.max(c), zero)
    return stacked.agg(
        *[total(c).alias(c) for c in ("rows_read", "rows_bad", "messages_ingested", "messages_analysed", "rescans")],
        F.greatest(F.lit(0.0), total("lag") / F.lit(1e6)).alias("lag_seconds"),
    )

"""Replays dropped within the overlap window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.vocabulary import OVERLAP_MINUTES
from chatlens.sources import schemas as S

_ARRIVED = "_arrived"


def drop_replays(arrivals: DataFrame, minutes: int = OVERLAP_MINUTES) -> DataFrame:
    """First arrival of each version of a message within ``minutes``.

    The edit date is part of the key, else edits would be dropped as replays.
    The watermark runs on the time of arrival: an edit keeps the time of its
    message and a first delivery may be late, and neither may be lost for it.
    State is kept for the overlap only; a replay that comes later passes, and the
    upsert makes nothing of it.
    """
    return (
        arrivals.withColumn(_ARRIVED, F.current_timestamp())
        .withWatermark(_ARRIVED, f"{minutes} minutes")
        .dropDuplicatesWithinWatermark([*S.KEY, "edit_date"])
        .drop(_ARRIVED)
    )

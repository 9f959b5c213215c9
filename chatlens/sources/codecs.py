"""Text forms of arrays and times, as row stores without such types keep them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_to_json(c: Column) -> Column:
    return F.to_json(c)


def json_to_array(c: Column) -> Column:
    """Array of strings; text that is no such JSON gives an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def time_to_iso(c: Column) -> Column:
    """ISO 8601 with offset; a fraction of six digits only if there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(c) % 1_000_000 == 0, whole).otherwise(fraction)


def iso_to_time(c: Column) -> Column:
    """Timestamp of an ISO 8601 text, null if it is none."""
    return F.try_to_timestamp(c)

"""All queries over the driver's tables."""

from __future__ import annotations

from catalogue import registry, report_queries, stream_queries, table_queries, text_queries  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.SQL)

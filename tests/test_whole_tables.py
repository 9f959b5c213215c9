"""Queries over rows that the small given tables do not have."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_queries  # noqa: E402

TEXTS = ("BTC is bullish, buy $BTC now", "sell $ETH, bearish", "nice weather")


@pytest.mark.parametrize("name", ["report_documents", "report_conversations"])
def test_report_over_large_ids(spark, tmp_path, name):
    turns = [(c, t, "user", TEXTS[(c + t) % 3]) for c in (1, 5_260, 5_261, 9_999, 3_000_000) for t in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    docs = [(n + k, TEXTS[k % 3]) for n in (0, 5_260_318, 5_260_330, 4_000_000_000) for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = check_queries.duckdb.connect()
    for table in ("conversations", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    status, _, _, note = check_queries.compare(spark, con, name, str(tmp_path))
    assert status == "ok", note

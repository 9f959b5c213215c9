"""Keyed streaming state: the fold of two rows, and expiry."""

import itertools
import random
import time

from pyspark.sql import functions as F

from catalogue import inputs as I
from catalogue.stream_queries import _STREAMED
from chatlens.operators import upsert
from chatlens.sources import scans
from chatlens.sources import schemas as S
from chatlens.sources.session import scratch_folder
from chatlens.sources.tables import ChatTables
from chatlens.streaming import live, metrics, state

NAMES = [f.name for f in state._HELD.fields]


def test_arrivals_fold_alike_in_any_order(spark, sf):
    rows = [r.asDict() for r in S.conform(I.arrivals(spark, sf), _STREAMED).where("message_id <= 60").collect()]
    want = {(r.chat_id, r.message_id): r.asDict() for r in upsert.fold_messages(spark.createDataFrame(rows, _STREAMED)).collect()}
    rng = random.Random(4)
    for _ in range(3):
        rng.shuffle(rows)
        held = {}
        for r in rows:
            key = r["chat_id"], r["message_id"]
            row = {c: r[upsert.SEQ] if c.endswith("_seq") else r[c] for c in NAMES}
            held[key] = state.fold_two(held.get(key), row)
        assert {k: {c: v[c] for c in NAMES[:-2]} for k, v in held.items()} == {k: {c: v[c] for c in NAMES[:-2]} for k, v in want.items()}
    two = [{**dict.fromkeys(NAMES), "text": t, "edit_date": e, "first_seq": s, "last_seq": s} for t, e, s in (("a", None, 1), ("b", 5, 2), ("c", 5, 3), ("d", None, 4))]
    for order in itertools.permutations(two):
        last = None
        for row in order:
            last = state.fold_two(last, row)
        assert (last["text"], last["first_seq"], last["last_seq"]) == ("b", 1, 2)


def test_keys_are_forgotten_when_their_time_is_over(spark, sf):
    state.use_disk_state(spark)
    folder, progress, out = (scratch_folder(spark, p) for p in ("source", "progress", "state"))
    rows = S.conform(I.messages(spark, sf), _STREAMED)
    parts = [rows.where("message_id <= 50"), rows.where("message_id BETWEEN 51 AND 60"), rows.where("message_id BETWEEN 61 AND 62")]
    held = []
    for part in parts:
        part.write.mode("append").parquet(folder)
        source = scans.stream(spark, folder, _STREAMED)
        state.start_expiring_state(source, out, progress, 3_000, {"availableNow": True}, slots=2).awaitTermination()
        held.append({r.message_id for r in state.held_state(spark, progress).collect()})
        time.sleep(4)
    assert len(held[0]) == 50 and held[2] <= set(range(51, 63)) and {61, 62} <= held[2]
    assert spark.read.parquet(out).select("message_id").distinct().count() == 62


def test_live_counts_come_without_a_job(spark, sf):
    """Counts of a stream while it runs equal those stored, and reading them starts no job."""
    tables = ChatTables(spark, scratch_folder(spark, "t"), buckets=2)
    folder, progress = scratch_folder(spark, "source"), scratch_folder(spark, "progress")
    rows = S.conform(I.messages(spark, sf), _STREAMED).where("message_id <= 90").withColumn(
        "text", F.when(F.col("message_id") % 9 != 0, F.col("text")))
    found = metrics.watch(spark)
    try:
        for part in (rows.where("message_id <= 50"), rows.where("message_id > 50")):
            part.write.mode("append").parquet(folder)
            live.start_ingest(scans.stream(spark, folder, S.T.StructType(_STREAMED.fields)), tables, progress, lambda b: b,
                              analyzed_at=I.at("2024-02-01 00:00:00"), trigger={"availableNow": True}, metrics=found, name="chats").awaitTermination()
        deadline = time.time() + 30
        while time.time() < deadline and (found.totals("chats").get("source_rows", 0) < 90 or found.totals("chats")["state"] != "ended"):
            time.sleep(0.2)
        got = found.totals("chats")
    finally:
        spark.streams.removeListener(found)
    stored = tables.notes().agg(F.sum("rows_read"), F.sum("rows_bad"), F.sum("rows_analysed")).first()
    assert (got["rows_read"], got["rows_bad"], got["rows_analysed"]) == tuple(stored) == (90, 10, 80)
    assert got["source_rows"] == 90 and got["state"] == "ended" and got["seconds"] > 0
    assert found.totals("none") == {"state": "unknown"}


def test_a_slot_is_dealt_into_small_groups(spark, sf, monkeypatch):
    """A task holds the keys of one group at a time, however many a slot has."""
    state.use_disk_state(spark)
    monkeypatch.setattr(state, "PARTS", 16)
    folder, progress, out = (scratch_folder(spark, p) for p in ("source", "progress", "state"))
    rows = S.conform(I.arrivals(spark, sf), _STREAMED).where("message_id <= 300")
    rows.write.parquet(folder)
    state.start_expiring_state(scans.stream(spark, folder, _STREAMED), out, progress, 3_600_000, {"availableNow": True}, slots=1).awaitTermination()
    held = spark.read.format("statestore").option("stateVarName", state.HELD).load(progress)
    groups = held.groupBy("key").count().collect()
    assert len(groups) == 16 and max(r["count"] for r in groups) < 60
    once = spark.read.parquet(out).groupBy(*S.KEY).count()
    assert once.where("count > 1").isEmpty() and once.count() == 300

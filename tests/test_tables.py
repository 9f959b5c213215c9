"""Merges, replays, re-scans and pruning of the stored tables."""

import datetime as dt
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from catalogue import inputs as I
from chatlens.operators import analyse, relational, upsert
from chatlens.plans import reports, rescan, stats
from chatlens.sources import schemas as S
from chatlens.sources.session import scratch_folder
from chatlens.sources import tables as tables_module
from chatlens.sources.tables import ChatTables
from chatlens.streaming import live


def _rows(df):
    return sorted(map(str, df.collect()))


def _tables(spark):
    return ChatTables(spark, scratch_folder(spark, "t"))


def test_merges_equal_one_fold(spark, sf):
    arrivals = I.arrivals(spark, sf)
    want = _rows(S.conform(upsert.fold_messages(arrivals), S.MESSAGES))
    tables = _tables(spark)
    assert tables.current("messages").count() == 0
    cuts = [0, 1500, 3_000_000_000_000, 10**15]
    for i in range(3):
        part = arrivals.where((F.col("ingest_seq") >= cuts[i]) & (F.col("ingest_seq") < cuts[i + 1]))
        tables.merge("messages", part)
        tables.merge("messages", part)
    assert _rows(tables.current("messages")) == want


def test_a_merge_writes_touched_partitions_only(spark, sf):
    tables = _tables(spark)
    rows = I.messages(spark, sf)
    tables.merge("messages", rows)
    before = {f for f in tables.stored("messages").inputFiles()}
    day = rows.where(F.to_date("ts_utc") == F.lit("2024-01-07"))
    tables.merge("messages", day.withColumn("text", F.lit("new")))
    after = {f for f in tables.stored("messages").inputFiles()}
    assert {re.search(r"day=([\d-]+)", f)[1] for f in before ^ after} == {"2024-01-07"}
    assert tables.current("messages").count() == rows.count()


def test_a_repeated_batch_changes_nothing_and_checkpoints_never_go_back(spark, sf):
    tables = _tables(spark)
    rows = S.conform(I.messages(spark, sf), S.MESSAGES).withColumn("ingest_seq", F.col("message_id"))
    late, early = rows.where("message_id > 500"), rows.where("message_id <= 500")
    now = I.at("2024-02-01 00:00:00")
    state = []
    for batch, part in ((0, late), (1, early), (1, early)):
        live.write_batch(tables, part, batch, now, analyse.LEXICON)
        state.append([_rows(tables.current(n)) for n in ("messages", "analysis", "ingest_checkpoint")])
    assert state[1] == state[2]
    assert state[0][2] == state[1][2]
    assert len(state[2][0]) == len(state[2][1]) == rows.count()
    counts = stats.ingest_stats(tables, now).first()
    assert (counts.rows_read, counts.messages_ingested, counts.rescans) == (rows.count(), rows.count(), 0)


def test_bad_lines_are_set_aside(spark):
    lines = spark.createDataFrame(
        [('{"chat_id":1,"id":2,"date":"2024-01-01T00:00:00Z","message":"hi"}',), ('{"chat_id":1,',),
         ('{"chat_id":1,"id":3}',), ("not json",), (None,)],
        "value string",
    )
    good, bad = live.split_bad(lines)
    assert [(r.id, r.message) for r in good.collect()] == [(2, "hi")]
    assert sorted(r.reason for r in bad.collect()) == ["no date", "not readable", "not readable", "not readable"]


def test_incomplete_rows_are_set_aside_and_defaults_set(spark, sf):
    rows = I.messages(spark, sf).withColumns(
        {"text": F.when(F.col("message_id") % 5 != 0, F.col("text")), "is_forwarded": F.lit(None).cast("boolean")}
    )
    tables = _tables(spark)
    live.write_batch(tables, rows, 3, I.at("2024-02-01 00:00:00"))
    bad = tables.quarantine("incomplete", S.T.StructType([S.T.StructField("reason", S.T.StringType())]))
    assert bad.where("reason = 'no text'").count() == rows.where("text IS NULL").count() == bad.count()
    held = tables.current("messages")
    assert held.count() == rows.where("text IS NOT NULL").count()
    assert held.where("is_forwarded OR is_forwarded IS NULL OR created_at IS NULL").count() == 0


def test_every_rescan_wins(spark, sf):
    arrivals = I.arrivals(spark, sf)
    tables = _tables(spark)
    first = F.col("ingest_seq") < 3_000_000_000_000
    live.write_batch(tables, arrivals.where(first), 0, I.at("2024-01-01 00:00:00"), analyse.LEXICON)
    span = I.at("2024-01-01 00:00:00"), I.at("2024-02-01 00:00:00")
    want = _rows(S.conform(upsert.fold_messages(arrivals), S.MESSAGES))
    for day in ("2024-03-01", "2024-03-05"):
        rescan.rescan_tables(tables, arrivals, *span, I.at(f"{day} 00:00:00"), analyse.LEXICON)
        assert _rows(tables.current("messages").drop("created_at")) == _rows(
            S.conform(upsert.fold_messages(arrivals), S.MESSAGES).drop("created_at")
        ) and len(want) == tables.current("messages").count()
        stamps = tables.current("analysis").select(F.col("analyzed_at").cast("string")).distinct().collect()
        assert [r[0] for r in stamps] == [f"{day} 00:00:00"]


def test_edits_after_an_analysis_are_found_and_redone(spark, sf):
    rows = S.conform(I.messages(spark, sf), S.MESSAGES).withColumn("ingest_seq", F.col("message_id"))
    tables = _tables(spark)
    live.write_batch(tables, rows, 0, I.at("2024-01-01 00:00:00"))
    nothing = I.at("2030-01-01 00:00:00"), I.at("2030-01-02 00:00:00")
    rescan.rescan_tables(tables, rows, *nothing, I.at("2024-03-01 00:00:00"), edited_since=I.at("2024-01-01 00:00:00"))
    redone = tables.current("analysis").where(F.col("analyzed_at") == I.at("2024-03-01 00:00:00"))
    assert redone.count() == rows.where(F.col("edit_date").isNotNull()).count()


def test_the_overlap_step_reads_the_last_minutes_and_old_edits(spark, sf):
    rows = S.conform(I.messages(spark, sf), S.MESSAGES).withColumn("ingest_seq", F.col("message_id"))
    tables = _tables(spark)
    live.write_batch(tables, rows, 0, I.at("2024-01-01 00:00:00"))
    now = I.at("2024-01-20 00:00:00")
    rescan.overlap_rescan(tables, rows, now, I.at("2024-03-01 00:00:00"), minutes=600)
    done = {(r.chat_id, r.message_id) for r in tables.current("analysis").where(F.col("analyzed_at") > I.at("2024-02-01 00:00:00")).collect()}
    start = I.at("2024-01-19 14:00:00")
    seen = rows.where(F.col("ts_utc").between(start, now) | (F.col("edit_date") >= start))
    assert done == {(r.chat_id, r.message_id) for r in seen.collect()}


def test_a_report_of_one_day_opens_that_day_only(spark, sf, capsys):
    tables = _tables(spark)
    live.write_batch(tables, I.messages(spark, sf), 0, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    start, end = dt.datetime(2024, 1, 7), dt.datetime(2024, 1, 7, 23, 59, 59)
    frame = reports.stored_frame(tables, 2, start, end)
    frame.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("PartitionFilters") == 2 and "day" in plan.split("PartitionFilters")[1] and "groupBy" not in plan
    whole = relational.report_frame(tables.current("messages"), tables.current("analysis"), 2, start, end)
    assert _rows(frame) == _rows(whole) and frame.count() > 0
    for name in ("messages", "analysis"):
        read = tables.stored(name).where(tables.within(name, 2, start, end))
        held = read.select(F.input_file_name().alias("f")).distinct().collect()
        assert {re.search(r"day=([\d-]+)", r.f)[1] for r in held} == {"2024-01-07"}
    assert reports.standard_report(tables, 2, start, end).count() > 0


def _files(tables, name):
    folder = pathlib.Path(tables.path(name).removeprefix("file:"))
    return {f: f.stat().st_size for f in folder.rglob("*.parquet")} if folder.exists() else {}


def test_a_small_batch_writes_little(spark, sf):
    tables = _tables(spark)
    rows = S.conform(I.messages(spark, sf), S.MESSAGES).withColumn("ingest_seq", F.col("message_id"))
    live.write_batch(tables, rows, 0, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    before = {n: _files(tables, n) for n in ("messages", "analysis", "edits", "ingest_checkpoint")}
    one = rows.where("message_id = 7")
    live.write_batch(tables, one, 1, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    for name, old in before.items():
        now = _files(tables, name)
        assert old.items() <= now.items()
        assert len(now) - len(old) <= 1 and sum(now.values()) - sum(old.values()) < 8_000
    assert tables.current("messages").count() == rows.count()


STATES = ("messages", "analysis", "edits", "ingest_checkpoint")


def _filled(spark, sf):
    """A table that got all arrivals in four batches, one of them twice."""
    tables = ChatTables(spark, scratch_folder(spark, "t"), buckets=2)
    arrivals = I.arrivals(spark, sf).where(F.col("ts_utc") < I.at("2024-01-15 00:00:00")).cache()
    cuts = [0, 300, 1500, 3_000_000_000_000, 10**15]
    for i in (0, 1, 1, 2, 3):
        part = arrivals.where((F.col("ingest_seq") >= cuts[i]) & (F.col("ingest_seq") < cuts[i + 1]))
        live.write_batch(tables, part, i, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    return tables, arrivals, {n: _rows(tables.current(n)) for n in STATES}


def test_settling_changes_files_only(spark, sf):
    tables, arrivals, want = _filled(spark, sf)
    held = _files(tables, "messages")
    tables.settle("messages", end=dt.date(2024, 1, 10))
    late = {f for f in held if re.search(r"day=([\d-]+)", str(f))[1] > "2024-01-10"}
    assert late and late == {f for f in _files(tables, "messages") if f in held}
    for name in STATES:
        tables.settle(name)
        assert _rows(tables.current(name)) == want[name]
        files = _files(tables, name)
        assert len(files) == len({f.parent for f in files})
        tables.settle(name)
        assert _files(tables, name) == files
    again = arrivals.where("ingest_seq >= 3000000000000")
    live.write_batch(tables, again, 9, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    assert [_rows(tables.current(n)) for n in STATES] == [want[n] for n in STATES]


class Killed(Exception):
    pass


@pytest.mark.parametrize("after", [None, 0, 7])
def test_a_settle_that_dies_loses_nothing(spark, sf, monkeypatch, after):
    """Killed before the fold is added (None), or after that and some deletes."""
    tables, arrivals, want = _filled(spark, sf)
    whole = tables_module.delete

    def dies(spark, files):
        files = sorted(files, reverse=True)
        whole(spark, files[:after])
        raise Killed

    def never(*_):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(tables_module, "delete", dies)
        if after is None:
            m.setattr(ChatTables, "_append", never)
        for name in STATES:
            with pytest.raises(Killed):
                tables.settle(name)
    assert [_rows(tables.current(n)) for n in STATES] == [want[n] for n in STATES]
    live.write_batch(tables, arrivals.where("ingest_seq >= 3000000000000"), 9, I.at("2024-02-01 00:00:00"), analyse.LEXICON)
    for name in STATES:
        tables.settle(name)
        assert _rows(tables.current(name)) == want[name]


def test_the_overlap_step_opens_folders_of_edits_only(spark, sf, capsys):
    rows = S.conform(I.messages(spark, sf), S.MESSAGES).withColumn("ingest_seq", F.col("message_id"))
    tables = _tables(spark)
    live.write_batch(tables, rows, 0, I.at("2024-01-01 00:00:00"))
    now = I.at("2030-01-01 00:00:00")
    edited = rows.where("edit_date IS NOT NULL").orderBy(F.col("edit_date").desc()).first()
    found = rescan.stale(tables, now, now, edited_since=F.lit(edited.edit_date))
    found.explain("formatted")
    plan = capsys.readouterr().out
    scans = [b for b in plan.split("\n\n") if "Scan parquet" in b and "Location" in b and ("/messages" in b or "/analysis" in b)]
    assert len(scans) >= 4 and all("PartitionFilters" in b for b in scans)
    assert sum("dynamicpruning" in b for b in scans) >= 2
    assert {(r.chat_id, r.message_id) for r in found.collect()} == {
        (r.chat_id, r.message_id) for r in rows.where(F.col("edit_date") >= F.lit(edited.edit_date)).collect()}


def test_the_analysis_of_the_stored_text_counts(spark):
    """A stale replay after an edit, a redone analysis, a newer edit, an arrival without one; settled after each or not."""
    def arrival(text, edited, seq):
        rows = spark.createDataFrame([(1, 5, text, edited, seq)], "chat_id long, message_id long, text string, edit_day int, ingest_seq long")
        day = F.when(F.col("edit_day").isNotNull(), F.timestamp_seconds(F.col("edit_day") * 86400 + F.unix_timestamp(I.at("2024-01-01 00:00:00"))))
        return S.conform(rows.withColumns({"ts_utc": I.at("2024-01-01 00:00:00"), "edit_date": day}),
                         S.T.StructType([*S.MESSAGES.fields, S.T.StructField(upsert.SEQ, S.T.LongType())]))

    def kept(tables):
        found = tables.current("analysis").collect()
        assert len(found) == 1
        return found[0].tokens, found[0].analyzed_at

    for settling in (False, True):
        tables = ChatTables(spark, scratch_folder(spark, "t"), analysis_of=tables_module.OF_STORED)

        def write(batch, text, edited, seq):
            live.write_batch(tables, arrival(text, edited, seq), batch, I.at("2024-01-02 00:00:00"))
            if settling:
                tables.settle("analysis")
            stored = tables.current("messages").collect()[0].text
            assert kept(tables)[0] == [r.tokens for r in analyse.annotate(spark.createDataFrame([(stored,)], "text string")).collect()][0]

        write(0, "gm", None, 0)
        write(1, "buy $ETH", None, 1)
        write(2, "buy $BTC", 3, 2)
        write(3, "gm", None, 3)
        assert kept(tables)[0] == ["BTC"]
        rescan.rescan_tables(tables, arrival("gm", None, 4).limit(0), I.at("2024-01-01 00:00:00"), I.at("2024-01-09 00:00:00"), I.at("2024-02-01 00:00:00"))
        if settling:
            tables.settle("analysis")
        assert kept(tables) == (["BTC"], dt.datetime(2024, 2, 1))
        write(5, "buy $SOL", 3, 5)
        write(6, "buy $ADA", 4, 6)
        assert kept(tables) == (["ADA"], dt.datetime(2024, 1, 2))
    with pytest.raises(ValueError):
        ChatTables(spark, "t", analysis_of="neither")

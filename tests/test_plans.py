"""What the physical plans must and must not hold."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

import catalogue
from catalogue import inputs as I
from catalogue import report_queries
from chatlens.functions import keypoints
from chatlens.operators import analyse, normalise, relational, report, token_report, upsert
from chatlens.sources import schemas as S
from chatlens.sources import session
from chatlens.sources.session import scratch_folder
from chatlens.sources.tables import save_clustered


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


LAZY = [n for n in sorted(catalogue.queries()) if not n.startswith(("stream_", "snapshot", "export", "batch_", "stored_", "backfill_then", "rescan_t", "ingest_stats"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_row_python(spark, sf, name):
    plan = plan_of(catalogue.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_analysis_is_one_narrow_pass(spark, sf):
    plan = plan_of(analyse.annotate(spark.read.parquet(f"{sf}/documents.parquet").select("text")))
    assert "Exchange" not in plan and "Python" not in plan


def test_report_filters_and_columns_reach_the_scan(spark, sf):
    folder = scratch_folder(spark, "plan")
    S.conform(I.messages(spark, sf), S.MESSAGES).write.parquet(f"{folder}/m")
    report_queries.stored_analysis(spark, sf).write.parquet(f"{folder}/a")
    m = spark.read.schema(S.MESSAGES).parquet(f"{folder}/m")
    a = spark.read.schema(S.ANALYSIS).parquet(f"{folder}/a")
    frame = relational.report_frame(m, a, 1, I.at("2024-01-02 00:00:00"), I.at("2024-01-03 00:00:00"))
    plan = plan_of(frame.agg(F.count_if("is_investment")))
    assert "GreaterThanOrEqual(ts_utc" in plan and "EqualTo(chat_id,1)" in plan
    schemas = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert all("text" not in s and "key_points" not in s for s in schemas)


def test_top_points_are_cut_before_the_shuffle(spark, sf):
    frame = report_queries.whole_frame(spark, sf)
    plan = plan_of(token_report.leading_points(token_report.mentions(frame)))
    assert plan.count("WindowGroupLimit") >= 2


def test_upsert_shuffles_once_after_partial_results(spark, sf):
    arrivals = spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("chat_id"), F.col("event_id").alias("message_id"), F.col("ts").alias("ts_utc"),
        F.col("props").alias("text"), F.col("ts").alias("edit_date"), F.array("props").alias("urls"),
        F.col("event_id").alias("ingest_seq"),
    )
    plan = plan_of(upsert.fold_messages(arrivals))
    tree = plan.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Aggregate") == 2


def test_tables_clustered_alike_join_without_a_shuffle(spark, sf):
    save_clustered(S.conform(I.messages(spark, sf), S.MESSAGES), "clustered_messages", 8)
    save_clustered(report_queries.stored_analysis(spark, sf), "clustered_analysis", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = relational.with_analysis(spark.table("clustered_messages"), spark.table("clustered_analysis"))
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == I.messages(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_directories_are_counted_once(spark, sf, monkeypatch):
    users, entities, raw = I.users(spark, sf), I.entities(spark, sf), I.raw_messages(spark, sf)
    counted = []
    whole = session.is_small
    monkeypatch.setattr(session, "is_small", lambda *a: counted.append(a) or whole(*a))
    normal = normalise.normaliser(users, entities)
    assert len(counted) == 2
    plans = [plan_of(normal(raw)) for _ in range(2)]
    assert len(counted) == 2
    assert all(p.split("\n\n\n")[0].count("BroadcastHashJoin") == 2 for p in plans)
    assert sorted(map(str, normal(raw).collect())) == sorted(map(str, normalise.normalise(raw, users, entities).collect()))


def test_bounds_are_arguments(spark, sf):
    frame = report_queries.whole_frame(spark, sf)
    row = report.previews(frame, ["chat_id"], rows=1, chars=5, tokens=None).first()
    assert len(row.preview) <= 8
    lines = "\n".join(f"- point number {i} about growth" for i in range(6))
    one = spark.createDataFrame([(lines,)], "r string").select(
        F.size(keypoints.reply_points(F.col("r"))).alias("two"), F.size(keypoints.reply_points(F.col("r"), None)).alias("all")).first()
    assert tuple(one) == (2, 6)
    text = ". ".join(t for t in I.TEMPLATES if "\n" not in t)
    few = spark.createDataFrame([(text,)], "t string").select(
        F.size(keypoints.text_points(F.col("t"), 1)).alias("one"), F.size(keypoints.text_points(F.col("t"), None)).alias("all")).first()
    assert few["one"] == 1 and few["all"] > 2

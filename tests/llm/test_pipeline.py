"""The corpus pipeline: every stage against its law, on the small tables and on odd rows."""

import pathlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from chatlens.llm import common, decontamination, simhash, toxicity


def test_stages(spark, sf, documents):
    seen = {}
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = common.table(stage(spark, docs, sf), "test")
        seen[name] = (docs, out)
        if name != "sharding":
            assert out.columns == documents.columns
        docs = out
    before, clean = seen["toxicity"]
    model = toxicity.model_for(before, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.scored(before, model).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in scores.items() if s < 0.5}
    before, single = seen["simhash near-dedup"]
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in simhash.near_groups(before).collect()}
    before, apart = seen["benchmark decontamination"]
    bad = {r.doc_id for r in decontamination.report(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.contaminated}
    assert {r.doc_id for r in apart.collect()} == {r.doc_id for r in before.collect()} - bad
    before, mixed = seen["mixing"]
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= {r.doc_id for r in before.collect()} and max(times.values()) <= 2
    before, final = seen["sharding"]
    rows = final.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in before.collect())
    sizes = Counter(r.shard for r in rows)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1


def test_odd_rows_pass_every_stage(spark, sf, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.table(stage(spark, docs, sf), "test")
        assert docs.columns[-2:] == ["shard", "slot"]


def test_run_is_repeatable(spark, sf):
    one = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).collect())
    two = sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).collect())
    assert Counter(r[0] for r in one) == Counter(r[0] for r in two) and Counter(r[1:] for r in one) == Counter(r[1:] for r in two)


def helper_names():
    """Every column name that the subpackage makes up for itself, from its source."""
    folder = pathlib.Path(common.__file__).parent
    source = "".join(f.read_text() for f in folder.glob("*.py")) + pathlib.Path(corpus_pipeline.__file__).read_text()
    return sorted(set(re.findall(r"\"(_[a-z_]+|rid|rank|copies|taken|target|score|passages|words|fp|root|key|pos|token|size|source_size|items|start|length|"
                                 r"n_hit|n_items|draw|spot|part|run|group|label|held_out|predicted|component_id|fingerprint)\"", source)))


def test_users_columns_come_out_as_they_went_in(spark, sf, documents):
    names = [n for n in helper_names() if n not in ("__main__",)]
    assert {"_did", "_th", "_len", "_of", "_copies", "_spot", "_shift", "_p", "score", "passages"} <= set(names)
    mine = {n: F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")) for n in names}
    docs = documents.withColumns(mine)
    for _, stage in corpus_pipeline.STAGES:
        out = common.table(stage(spark, docs, sf), "test")
        assert out.columns[:len(docs.columns)] == docs.columns
        assert out.count() > 0
        wrong = " OR ".join(f"`{n}` IS DISTINCT FROM concat('{n}:', doc_id)" for n in names)
        assert out.where(wrong).count() == 0
        docs = out
    plain = [(r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, sf).select("doc_id", "shard", "slot").collect()]
    assert Counter(r.doc_id for r in docs.collect()) == Counter(r[0] for r in plain)

"""The treap against the plain grid, and the search against scores of all documents."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from chatlens.llm import common
from chatlens.llm import treap_search as ts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in WORD.findall(text or "")]


def by_hand(docs, items, k=ts.TOP):
    """Sorted (item_id, rank, doc_id, score) by scoring every document for every item."""
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    df = {}
    for _, w in bags:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, w in bags:
            score = 0
            for t in set(terms(text)) & set(w):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + 90 * len(w) * n_docs // total
                score += weight * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shape", [(1, 1), (3, 200), (300, 5), (97, 130)])
def test_treap_equals_grid(shape):
    rng = np.random.default_rng(5)
    grid = rng.integers(1, 40, shape) * (rng.random(shape) < 0.3) * 20_000
    grid[0, 0] = 1_000_000
    rows, cols = np.nonzero(grid)
    packed = ts.compress(rows, cols, grid[rows, cols])
    treap = ts.Treap(**packed)
    assert len(treap.most[-1]) - 1 == len(rows) and sorted(treap.most[-1][:-1]) == sorted(grid[rows, cols])
    assert len(packed["masks"]) <= sum((len(m) + 1) // 2 for m in treap.masks)
    for _ in range(40):
        picked = rng.choice(shape[0], size=min(shape[0], int(rng.integers(1, 9))), replace=False)
        weights = rng.integers(1, 4, len(picked))
        score = weights @ grid[picked]
        k, least = int(rng.integers(1, 30)), int(rng.choice([1, 500_000]))
        columns, scores = treap.best(picked, weights, k, least)
        assert len(set(columns)) == len(columns) and (scores == score[columns]).all()
        good = score >= least
        bound = np.sort(score[good])[::-1][k - 1] if good.sum() >= k else least
        assert set(columns) == set(np.flatnonzero(score >= bound))


def test_few_states_are_opened():
    """Best first: a column that stands out is found without the others being opened."""
    grid = np.ones((64, 4096), dtype=np.int64)
    grid[:, 1234] = 1000
    rows, cols = np.nonzero(grid)
    treap = ts.Treap(**ts.compress(rows, cols, grid[rows, cols]))
    opened, plain = [], treap.opened
    treap.opened = lambda level, nodes, *a: opened.append(len(nodes)) or plain(level, nodes, *a)
    columns, _ = treap.best(np.arange(8), np.ones(8, dtype=np.int64), 1)
    assert columns.tolist() == [1234] and sum(opened) <= 2 * ts.BATCH * treap.height


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["Été", "ÉTÉ", "naïve", "日本", "X", "x", "a1"]
    docs = [(i, rng.choice([" ", "-", "\n", "_", "\x7f"]).join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 200])))) for i in range(150)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [docs[5], docs[5], (None, docs[7][1]), (None, None), (7, ""), (8, " -- ")]
    docs.append((2000, "w1 w2 naïve " * 50_000))
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(12)] + [
        (20, docs[3][1]), (20, docs[3][1]), (21, None), (22, "..."), (23, "unknown"), (None, "w1 été")]
    return docs, items


@pytest.mark.parametrize("docs_of_range, block", [(8192, 100_000), (7, 9), (1, 40)])
def test_search_equals_scores_of_all(spark, corpus, monkeypatch, docs_of_range, block):
    monkeypatch.setattr(ts, "RANGE_DOCS", docs_of_range)
    monkeypatch.setattr(ts, "BLOCK_TERMS", block)
    monkeypatch.setattr(ts, "RANGE_BYTES", 1 << 20)
    docs, items = corpus
    clash = {c: F.lit("x") for c in ("rid", "terms", "score", "rank", "n", "masks")}
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    got = sorted((tuple(r) for r in ts.search(ts.build(frame), asked).collect()), key=str)
    assert got == by_hand(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(x, f"{c} long, text string") for x, c in zip(corpus, ("doc_id", "item_id")))
    none = docs.limit(0)
    assert ts.search(ts.build(none), items).count() == 0
    assert ts.search(ts.build(docs.where("text IS NULL")), items).count() == 0
    assert ts.search(ts.build(docs), items.limit(0)).count() == 0


def test_a_task_holds_one_range_at_a_time(spark, monkeypatch):
    """Ranges come to a search one by one, from row groups of their own, however many a partition has."""
    monkeypatch.setattr(ts, "RANGE_DOCS", 1)
    monkeypatch.setattr(common, "BATCH_BYTES", 100_000)
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("doc_id")).cast("string"))), " ")
    index = ts.build(spark.range(6).select(F.col("id").alias("doc_id")).withColumn("text", words).coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in index.inputFiles()]
    assert [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)] == [1] * 6

    def counted(terms, queries, k):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict(
                    {"rid": [queries[0][0]], "doc_id": [batch.num_rows], "score": [1]},
                    schema=pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))
        return run

    before = spark.conf.get(common.BATCH_SETTING)
    items = spark.createDataFrame([(1, "w7")], "item_id long, text string")
    assert [r.doc_id for r in ts.search(index, items).collect()] != []
    monkeypatch.setattr(ts, "_searched", counted)
    assert [r.doc_id for r in ts.search(index, items).collect()] == [1] * 6
    assert spark.conf.get(common.BATCH_SETTING) == before

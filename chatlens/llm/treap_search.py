"""Ranked lexical search on K2-treaps over the grid of terms and documents.

Documents are indexed in ranges. The grid of a range has a row for each term
and a column for each document; a cell holds the impact of the term in the
document. The grid is a quadtree: a node has four bits for its quadrants that
are not empty, and the largest impact in it as the fall from its parent's. A
query follows the paths of all its rows at once: a state is a range of columns
and the node of every row there, its bound the weighed sum of their maxima.
States are opened best first, many at a time; at single columns the bound is the
score, so the search ends when no bound reaches the k-th score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatlens.llm import common

TOP = 10
#: A range of documents ends at so many bytes of text or documents, whichever comes first.
RANGE_BYTES = 8 << 20
RANGE_DOCS = 8192
#: States opened at once.
BATCH = 64
#: Terms of one block of queries; more are searched for block after block.
BLOCK_TERMS = 100_000
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PLAIN = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))
_ONES = np.array([bin(m).count("1") for m in range(16)], dtype=np.int32)
_PLANES = 3  # impacts are at most a million
#: A row of the index is megabytes: each has a row group of its own, so readers and writers hold one at a time.
_ROW_GROUPS = {"parquet.block.row.count.limit": 1}

INDEX = "doc_ids array<long>, terms binary, dfs binary, masks binary, falls binary, top int, height int, n_docs long, n_terms long"


def impact(tf, n, n_docs: int, n_terms: int):
    """The part of a score that term and document decide, in whole numbers."""
    m = 10 + (90 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def postings(texts: list[bytes]):
    """Distinct terms of some texts, and (term, text, uses) of every pair; terms in falling order of their texts."""
    data = np.frombuffer(b" ".join(texts).translate(_PLAIN), dtype=np.uint8)
    inside = np.concatenate(([False], data != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2].copy()
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(edges[1::2] - starts, out=offsets[1:])
    letters = np.ascontiguousarray(data[inside[1:-1]])
    del edges, inside, data
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    ).dictionary_encode()
    del offsets, letters
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    doc = np.searchsorted(begins, starts, side="right") - 1
    del starts
    doc += packed.indices.to_numpy().astype(np.int64) * len(texts)
    pairs, uses = np.unique(doc, return_counts=True)
    del doc
    term, doc = pairs // len(texts), pairs % len(texts)
    del pairs
    dfs = np.bincount(term, minlength=len(packed.dictionary))
    order = np.argsort(-dfs, kind="stable")
    row = np.empty(len(order), dtype=np.int64)
    row[order] = np.arange(len(order))
    return packed.dictionary.take(pa.array(order)), dfs[order], row[term], doc, uses.astype(np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """A zero between any two bits."""
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & keep
    return x


def compress(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> dict:
    """The treap of a grid with at least one cell: bits and falls of its levels, from the root down."""
    height = max(int(rows.max()).bit_length(), int(cols.max()).bit_length(), 1)
    cells = (_spread(rows.astype(np.int64)) << 1) | _spread(cols.astype(np.int64))
    order = np.argsort(cells)
    cells, values = cells[order], values[order].astype(np.int32)
    del order
    masks, falls = [], []
    for _ in range(height):
        up = cells >> 2
        heads = np.flatnonzero(np.concatenate(([True], up[1:] != up[:-1])))
        masks.append(np.add.reduceat(1 << (cells & 3), heads).astype(np.uint8))
        most = np.maximum.reduceat(values, heads)
        falls.append(np.repeat(most, np.diff(np.append(heads, len(cells)))) - values)
        cells, values = up[heads], most
    packed = [np.append(m, [0] * (len(m) % 2)).astype(np.uint8).reshape(-1, 2) @ np.array([1, 16], dtype=np.uint8) for m in reversed(masks)]
    planes = [((f[None, :] >> np.arange(0, 8 * _PLANES, 8)[:, None]) & 255).astype(np.uint8) for f in reversed(falls)]
    return {
        "masks": b"".join(p.tobytes() for p in packed), "falls": b"".join(p.tobytes() for p in planes),
        "top": int(values[0]), "height": height,
    }


class Treap:
    """An opened treap: for every level the masks, the first child and the maximum of each node.

    Every level ends with one more node that is empty.
    """

    def __init__(self, masks: bytes, falls: bytes, top: int, height: int):
        self.height = height
        self.masks, self.first, self.most = [], [], [np.array([top, 0], dtype=np.int32)]
        bits, planes, at, fall_at, n = np.frombuffer(masks, np.uint8), np.frombuffer(falls, np.uint8), 0, 0, 1
        for _ in range(height):
            half = (n + 1) // 2
            level = np.stack((bits[at:at + half] & 15, bits[at:at + half] >> 4), axis=1).reshape(-1)[:n]
            ones = _ONES[level]
            below = int(ones.sum())
            self.masks.append(np.append(level, 0).astype(np.uint8))
            self.first.append(np.append(np.cumsum(ones) - ones, below).astype(np.int32))
            most = np.zeros(below + 1, dtype=np.int32)
            most[:below] = np.repeat(self.most[-1][:-1], ones)
            for p, plane in enumerate(planes[fall_at:fall_at + _PLANES * below].reshape(_PLANES, below)):
                most[:below] -= plane.astype(np.int32) << (8 * p)
            self.most.append(most)
            at, fall_at, n = at + half, fall_at + _PLANES * below, below

    def opened(self, level: int, nodes: np.ndarray, rows: np.ndarray, right: int):
        """The children of states on one half of their columns, and their maxima by row."""
        quadrant = ((rows >> (self.height - 1 - level)) & 1) * 2 + right
        mask = self.masks[level][nodes]
        child = self.first[level][nodes] + _ONES[mask & ((1 << quadrant) - 1)]
        child = np.where((mask >> quadrant) & 1, child, len(self.most[level + 1]) - 1)
        return child, self.most[level + 1][child]

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, least: int = 1):
        """Columns and scores of the k best columns that score ``least`` at least, with all that tie with the last."""
        waiting = {0: (np.array([int(self.most[0][0]) * weights.sum()]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32))}
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while waiting:
            level = max(waiting, key=lambda x: waiting[x][0].max())
            bounds, columns, nodes = waiting.pop(level)
            if bounds.max() < least:
                break
            if len(bounds) > BATCH:
                order = np.argpartition(-bounds, BATCH)
                rest = order[BATCH:][bounds[order[BATCH:]] >= least]
                if len(rest):
                    waiting[level] = bounds[rest], columns[rest], nodes[rest]
                columns, nodes = columns[order[:BATCH]], nodes[order[:BATCH]]
            for right in (0, 1):
                below, most = self.opened(level, nodes, rows, right)
                reach = most @ weights
                kept = np.flatnonzero(reach >= least)
                if not len(kept):
                    continue
                reach, places, below = reach[kept], columns[kept] * 2 + right, below[kept]
                if level + 1 == self.height:
                    found, scores = np.concatenate((found, places)), np.concatenate((scores, reach))
                    if len(scores) >= k:
                        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                        good = scores >= least
                        found, scores = found[good], scores[good]
                elif level + 1 in waiting:
                    waiting[level + 1] = tuple(np.concatenate(x) for x in zip(waiting[level + 1], (reach, places, below)))
                else:
                    waiting[level + 1] = reach, places, below
        return found, scores


def _indexed(n_docs: int, n_terms: int):
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("dfs", pa.binary()), ("masks", pa.binary()), ("falls", pa.binary()),
                        ("top", pa.int32()), ("height", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def one(ids, texts):
        terms, dfs, row, doc, tf = postings(texts)
        if not len(terms):
            return None
        n = np.bincount(doc, weights=tf, minlength=len(texts)).astype(np.int64)
        # columns by length: what a range of columns holds is alike, so its maxima say more
        order = np.argsort(n, kind="stable")
        column = np.empty(len(order), dtype=np.int64)
        column[order] = np.arange(len(order))
        grid = compress(row, column[doc], impact(tf, n[doc], n_docs, n_terms))
        return pa.RecordBatch.from_pylist([{
            "doc_ids": [ids[i] for i in order], "terms": b"\n".join(terms.to_pylist()), "dfs": dfs.astype(np.uint32).tobytes(),
            "n_docs": n_docs, "n_terms": n_terms, **grid,
        }], schema=schema)

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                if ids and (size + len(text) > RANGE_BYTES or len(ids) >= RANGE_DOCS):
                    if (out := one(ids, texts)) is not None:
                        yield out
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
        if ids and (out := one(ids, texts)) is not None:
            yield out

    return run


def build(docs: DataFrame) -> DataFrame:
    """The index: a row for each range of documents, all terms of all documents, no shuffle.

    ``docs`` has ``doc_id, text``; other columns are not read. Null and empty
    texts have no terms and are never found; repeated rows are documents of
    their own. Impacts hold for the documents that the index was built on.
    """
    parts = F.array_remove(F.split("text", BETWEEN), "")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with common.small_batches(docs.sparkSession):
        return common.table(rows.mapInArrow(_indexed(n_docs, n_terms), INDEX), "treaps", _ROW_GROUPS)


def _rows(batches):
    """The rows of batches one by one, as values that share the batch's memory."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}


def _found_in(wanted: pa.Array, terms: pa.Scalar) -> pa.Array:
    """Places of wanted terms in a row of the index, null where it has none."""
    return pc.index_in(wanted, value_set=pa.array(terms.as_py().split(b"\n"), pa.binary()))


def _term_counts(terms: list[bytes]):
    wanted = pa.array(terms, pa.binary())

    def run(batches):
        total = np.zeros(len(terms), dtype=np.int64)
        for r in _rows(batches):
            at = _found_in(wanted, r["terms"])
            held = at.is_valid().to_numpy(zero_copy_only=False)
            dfs = np.frombuffer(r["dfs"].as_buffer(), dtype=np.uint32)
            total[held] += dfs[at.drop_null().to_numpy()]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["term", "df"])

    return run


def _searched(terms: list[bytes], queries: list, k: int):
    """``queries`` are (number, places of terms, weights)."""
    wanted = pa.array(terms, pa.binary())

    def key(hit):
        return -hit[1], hit[0] is None, hit[0] or 0

    def run(batches):
        tops, treap = [[] for _ in queries], None
        for r in _rows(batches):
            del treap  # before the next one is opened
            at = _found_in(wanted, r["terms"]).fill_null(-1).to_numpy()
            treap = Treap(r["masks"].as_buffer(), r["falls"].as_buffer(), r["top"].as_py(), r["height"].as_py())
            for i, (_, places, weights) in enumerate(queries):
                rows = at[places]
                held = np.flatnonzero(rows >= 0)
                if not len(held):
                    continue
                least = tops[i][-1][1] if len(tops[i]) == k else 1
                columns, scores = treap.best(rows[held], weights[held], k, least)
                if len(columns):
                    hits = list(zip(r["doc_ids"].values.take(pa.array(columns)).to_pylist(), scores.tolist()))
                    tops[i] = sorted(tops[i] + hits, key=key)[:k]
        flat = [(queries[i][0], doc_id, score) for i, top in enumerate(tops) for doc_id, score in top]
        yield pa.RecordBatch.from_pydict(
            {"rid": [x[0] for x in flat], "doc_id": [x[1] for x in flat], "score": [x[2] for x in flat]},
            schema=pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]),
        )

    return run


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents of every item.

    ``items`` has ``item_id, text``; other columns are not read. Items go to
    the tasks in blocks of ``BLOCK_TERMS`` terms; each task holds one range at a
    time and returns k documents of each item. Equal scores stand by ``doc_id``, null last. An item without
    terms, or without a document that holds one, has no rows; each of several
    rows with one ``item_id`` is searched for. A null ``item_id`` is a value.
    """
    spark = items.sparkSession
    words = F.array_distinct(F.array_remove(F.split(F.translate("text", _UPPER, _UPPER.lower()), BETWEEN), ""))
    listed = items.select("item_id", words.alias("terms")).where("size(terms) > 0").withColumn("rid", F.monotonically_increasing_id())
    listed = common.table(listed, "items")
    blocks = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    head = index.select("n_docs").first()
    hit = "rid long, doc_id long, score long"
    found = spark.createDataFrame([], hit)
    for b in range(blocks if head else 0):
        rows = listed.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).select("rid", "terms").collect()  # about BLOCK_TERMS terms
        terms = sorted({t for r in rows for t in r.terms})
        place = {t: i for i, t in enumerate(terms)}
        coded = [t.encode() for t in terms]
        counts = index.select("terms", "dfs").mapInArrow(_term_counts(coded), "term int, df long").groupBy("term").agg(F.sum("df"))
        weight = np.zeros(len(terms), dtype=np.int64)
        with common.small_batches(spark):
            held = counts.collect()  # at most BLOCK_TERMS rows
        for term, df in held:
            weight[term] = math.floor(1000 * math.log((2 * head.n_docs + 2) / (2 * df + 1)))
        queries = []
        for r in rows:
            places = np.array([place[t] for t in r.terms], dtype=np.int64)
            places = places[weight[places] > 0]
            queries.append((r.rid, places, weight[places]))
        grids = index.select("doc_ids", "terms", "masks", "falls", "top", "height")
        with common.small_batches(spark):
            found = found.union(common.table(grids.mapInArrow(_searched(coded, queries, k), hit), "hits"))
    by_score = Window.partitionBy("rid").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return best.join(listed.select("rid", "item_id"), "rid").select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS q, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), s AS (
  SELECT (count(*) FILTER (len(w) > 0))::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), p AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t
), f AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT t, count(*) AS df FROM p GROUP BY t), s
), m AS (
  SELECT r, doc_id, 100 - 90 + (90 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, s
), g AS (
  SELECT q, r, sum(f.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM (SELECT q, unnest(w) AS t FROM b) JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY q, r
), k AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM g JOIN m USING (r) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 10
"""

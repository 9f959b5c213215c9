"""SimHash near-duplicates with pivot distance tables.

A fingerprint is compared through its Hamming distances to many reference
fingerprints (pivots): by the triangle inequality two fingerprints that differ in
at most ``max_bits`` bits have distances to every pivot that differ by no more.

Distances over the full width concentrate around half the bits and so part
hardly any pairs alone. The tables therefore also hold the distances over
segments of the width. With ``max_bits + k`` segments, ``k`` of them hold no
differing bit at all for a linked pair, so all their coordinates are equal: the
coordinates of each choice of ``k`` segments are an exact join key, and no linked
pair misses them all. What shares a key is then filtered by the largest
difference of full-width coordinates, and the survivors are verified.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm import common

WORDS = 4
MAX_BITS = 4
HASH_SEED = 42
#: References for each segment; enough that unequal segments rarely agree.
SEGMENT_PIVOTS = 16
#: References over the full width.
PIVOTS = 16
#: Candidates for each fingerprint above which finer segments are used.
MAX_EXPECTED = 1000
#: Groups above this size grow their components from one fingerprint at a time.
SMALL_GROUP = 64
#: Groups above this size whose rows are mostly unlinked are keyed again by bits not compared yet.
BIG_GROUP = 4096
#: Segments that are equal within a key of such a group.
MORE_EQUAL = 4
#: Components for each row above which a group counts as mostly unlinked.
UNLINKED = 1 / 8


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of word shingles; 0 for a text without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(tokens)
    if n == 0:
        return 0
    joined = b" ".join(tokens)
    if n < words:
        spans = [(0, len(joined))]
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        spans = zip((ends - lengths)[: n - words + 1].tolist(), ends[words - 1 :].tolist())
    hashed = xxhash.xxh64_intdigest
    seed = HASH_SEED
    codes = np.array([hashed(joined[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 16):
        part = codes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(codes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprinted(docs: DataFrame, columns: list[str], words: int = WORDS) -> DataFrame:
    """``columns`` of the documents and ``fp``, the fingerprint of ``text``."""

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            fps = [fingerprint(t, words) for t in table.column("text").to_pylist()]
            yield from table.drop_columns(["text"]).append_column("fp", pa.array(fps, pa.int64())).to_batches()

    schema = T.StructType(list(docs.select(*columns).schema.fields)).add("fp", T.LongType())
    return docs.select(*columns, "text").mapInArrow(run, schema)


def _pivots(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", HASH_SEED) for i in range(n)], np.uint64)


def _segments(n: int, free: int = (1 << 64) - 1) -> list[np.uint64]:
    """Masks of ``n`` runs of nearly equal width of the bits that ``free`` has."""
    bits = [b for b in range(64) if free >> b & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [np.uint64(sum(1 << b for b in bits[i:j])) for i, j in zip(cuts, cuts[1:])]


def plan_segments(n: int, max_bits: int = MAX_BITS) -> int:
    """How many segments to use for ``n`` fingerprints; any choice finds all links."""
    for more in range(1, 9):
        s = max_bits + more
        if n * comb(s, more) / 2.0 ** (64 * more / s) <= MAX_EXPECTED:
            return s
    return max_bits + 8


def _keyed(x: np.ndarray, segments: int, equal: int, free: int = (1 << 64) - 1, within: int = 0):
    """For each choice of ``equal`` segments of ``free``: a key of each fingerprint, and the bits left free.

    ``within`` is the key that the fingerprints share so far.
    """
    refs, masks = _pivots(SEGMENT_PIVOTS), _segments(segments, free)
    spread = _pivots(segments + 1) | np.uint64(1)
    codes = []
    for mask in masks:
        code = np.zeros(len(x), np.uint64)
        for ref in refs:
            code = code * np.uint64(1_000_003) + np.bitwise_count((x ^ ref) & mask).astype(np.uint64)
        codes.append(code)
    for i, chosen in enumerate(combinations(range(segments), equal)):
        key = np.full(len(x), np.uint64(i)) * spread[segments] ^ np.uint64(within)
        left = free
        for g in chosen:
            key = (key ^ codes[g]) * spread[g]
            key ^= key >> np.uint64(29)
            left &= ~int(masks[g])
        yield key, left


def _rows(a, b, key=None, free=None) -> pa.RecordBatch:
    """Links ``(a, b)``, or fingerprints ``a`` with the key to compare them by."""
    a = pa.array(a.view(np.int64))
    b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
    key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))
    free = pa.nulls(len(a), pa.int64()) if free is None else pa.array(np.full(len(a), free, np.uint64).view(np.int64))
    return pa.RecordBatch.from_arrays([a, b, key, free], ["a", "b", "key", "free"])


_ROWS = "a long, b long, key long, free long"


def _keys(fps: DataFrame, segments: int, max_bits: int) -> DataFrame:
    """``(a, key, free)``: one row for each choice of segments that may hold no differing bit."""

    def run(batches):
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for key, free in _keyed(x, segments, segments - max_bits):
                yield _rows(x, None, key, free)

    return fps.select("fp").mapInArrow(run, _ROWS)


def _group_links(key: np.ndarray, x: np.ndarray, max_bits: int):
    """Forests of linked fingerprints within each run of equal keys, as arrays (a, b)."""
    table = np.stack([np.bitwise_count(x ^ p) for p in _pivots(PIVOTS)], axis=1).astype(np.int8)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found_a, found_b = [], []

    def linked(i, j):
        near = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= max_bits)
        i = i[near] if np.ndim(i) else i
        j = j[near]
        sure = np.bitwise_count(x[i] ^ x[j]) <= max_bits
        return (i[sure] if np.ndim(i) else i), j[sure]

    small = sizes <= SMALL_GROUP
    at = np.arange(len(key))
    left = np.repeat(starts + sizes, sizes) - at  # rows of the group from here on
    rows = at[np.repeat(small, sizes)]
    lag = 1
    while len(rows := rows[left[rows] > lag]):
        i, j = linked(rows, rows + lag)
        found_a.append(i)
        found_b.append(j)
        lag += 1
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        rest = np.arange(start, start + size)
        while len(rest):
            frontier, rest = [rest[0]], rest[1:]
            while frontier and len(rest):
                i = frontier.pop()
                _, j = linked(i, rest)
                if len(j):
                    found_a.append(np.full(len(j), i))
                    found_b.append(j)
                    frontier.extend(j.tolist())
                    rest = rest[~np.isin(rest, j, assume_unique=True)]
    if not found_a:
        return x[:0], x[:0]
    return x[np.concatenate(found_a)], x[np.concatenate(found_b)]


def _is_unlinked(x: np.ndarray, max_bits: int) -> bool:
    """Whether comparing a group in one task would take time with the square of its rows."""
    a, _ = _group_links(np.zeros(len(x), np.int64), x, max_bits)
    return len(x) - len(a) > UNLINKED * len(x)  # a forest of a edges leaves so many components


def _compared(batches, max_bits: int, last: bool):
    """Links of rows sorted by key; rows of big unlinked groups come back with finer keys.

    Of such a group at most ``BIG_GROUP`` rows and a batch are held. ``last`` is set
    where no finer key exists.
    """
    held = {"key": np.zeros(0, np.int64), "a": np.zeros(0, np.uint64), "free": np.zeros(0, np.int64)}
    split = seen = None  # the key that is being keyed again, and the one found to be linked

    def finer(key, x, free):
        free = int(free) & ((1 << 64) - 1)
        segments = max_bits + MORE_EQUAL
        for k, left in _keyed(x, segments, MORE_EQUAL, free, int(key) & ((1 << 64) - 1)):
            yield _rows(x, None, k, left)

    def compared(part):
        if len(part["key"]):
            yield _rows(*_group_links(part["key"], part["a"], max_bits))

    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in held}
        new["a"] = new["a"].view(np.uint64)
        rows = {c: np.concatenate([held[c], new[c]]) for c in held}
        if not len(rows["key"]):
            continue
        if split is not None:
            end = int(np.searchsorted(rows["key"], split, "right"))
            yield from finer(split, rows["a"][:end], free)
            rows = {c: v[end:] for c, v in rows.items()}
            if not len(rows["key"]):
                held = rows
                continue
            split = None
        # the last group may go on in the next batch; others are whole
        at = int(np.searchsorted(rows["key"], rows["key"][-1], "left"))
        starts = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        ends = np.r_[starts[1:], len(rows["key"])]
        big = [(i, j) for i, j in zip(starts.tolist(), ends.tolist()) if j - i > BIG_GROUP and not last]
        small = np.ones(len(rows["key"]), bool)
        small[at:] = False
        for i, j in big:
            key = rows["key"][i]
            if key != seen and _is_unlinked(rows["a"][i : i + BIG_GROUP], max_bits):
                small[i:j] = False
                free = rows["free"][i]
                yield from finer(key, rows["a"][i:j], free)
                if i == at:
                    split, at = key, j
            else:
                seen = key
        yield from compared({c: v[small] for c, v in rows.items()})
        held = {c: v[at:] for c, v in rows.items()}
    yield from compared(held)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that connect just what pairs within ``max_bits`` bits connect.

    ``fps`` has distinct ``fp``. A group of small size gives all its links; in a
    larger one each fingerprint is linked once, when it is first reached, which
    keeps the links linear in the size of a dense group. Big groups of mostly
    unlinked fingerprints are dealt again by segments of the bits in which they may
    still differ, until a key leaves so few bits that its groups are small.
    """
    segments = plan_segments(fps.count(), max_bits)
    rows = _keys(fps, segments, max_bits)
    left = 64 * max_bits / segments
    found = []
    while True:
        last = left < max_bits + MORE_EQUAL  # a segment would have no bit
        run = partial(_compared, max_bits=max_bits, last=last)
        dealt = rows.select("a", "key", "free").repartition(common.partitions(fps), "key").sortWithinPartitions("key")
        out = common.cut(dealt.mapInArrow(run, _ROWS))
        found.append(out.where("b IS NOT NULL").select("a", "b"))
        rows = out.where("b IS NULL")
        if last or rows.isEmpty():
            break
        left = left * max_bits / (max_bits + MORE_EQUAL)
    return reduce(DataFrame.union, found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``, the root being the smallest node.

    Large and small stars in turn: every step hangs neighbours under the smallest
    one known, so chains shorten geometrically. Each round is cut by a checkpoint.
    """
    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = common.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = common.cut(
            small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def grouped(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Add ``root``, the fingerprint that stands for the component, to rows with ``fp``.

    Fingerprints are compared once each, however many rows hold them. Only linked
    ones have a row in the joined table; it is cut, so that both sides of the join
    are plain shuffles and Spark can split a fingerprint of a third of all rows.
    """
    found = common.cut(components(links(rows.select("fp").distinct(), max_bits)))
    return rows.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Null and empty texts have the fingerprint zero and are linked like others.
    Repeated rows stay. ``component_id`` is the smallest ``doc_id`` of the
    component; nulls are passed over, so it is null only where all are.
    """
    rows = common.cut(fingerprinted(docs, ["doc_id"], words))
    whole = grouped(rows, max_bits)
    first = common.cut(whole.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return whole.join(first, "root").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group: that of the smallest ``doc_id``, null last; of equal ones any row."""
    rid = common.fresh(docs, "_rid")
    rows = common.table(docs.withColumn(rid, F.monotonically_increasing_id()), "simhash")
    narrow = common.cut(fingerprinted(rows.select(F.col(rid).alias("rid"), "doc_id", "text"), ["rid", "doc_id"], words))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    kept = grouped(narrow, max_bits).groupBy("root").agg(F.min(place)["rid"].alias("_of"))
    return rows.join(kept, rows[rid] == kept["_of"], "left_semi").drop(rid)


def op4(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Removal of repeated passages with sharded Aho-Corasick automata.

A window of thirteen words that two texts share has the same anchor in both: of
its six-word phrases the one with the smallest hash. So windows are compared
only where an anchor occurs in several texts.

1. Each text yields its anchors; those of several texts are kept.
2. Texts with such anchors are cut to the stretches of words whose windows have
   that anchor. A stretch goes to the shard of its anchor.
3. A shard confirms which windows recur, word by word, compiles them to an
   automaton, and streams its stretches through it; every occurrence in a
   document other than the first is a span to remove.
4. The spans of each document are united and cut out.

Sending a stretch only to the shard that can hold its windows keeps the work in
proportion to the repeated text; every document through every shard would not.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm import common

WINDOW = 13
ANCHOR = 6
#: Stretches of one anchor above which it is dealt to several tasks.
HOT = 20_000
#: Stretches that go into one automaton, about.
PER_AUTOMATON = 5_000
#: Bits of the map of repeated anchors that tasks get: a fixed size. With more
#: anchors it lets more pass, and the join after it sorts them out.
MAP_BITS = 1 << 27
#: A null id counts as larger than any.
LAST = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, first window, end of windows)`` of each run of windows with one anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < WINDOW:
        return none, none, none
    hashed = xxhash.xxh64_intdigest
    codes = np.array([hashed(w) for w in words], np.uint64)
    n = len(codes) - ANCHOR + 1
    phrase = codes[:n].copy()
    for k in range(1, ANCHOR):
        phrase = phrase * _BASE + codes[k : k + n]
    phrase ^= phrase >> np.uint64(29)
    phrase *= np.uint64(0xBF58476D1CE4E5B9)
    phrase ^= phrase >> np.uint64(32)
    span = WINDOW - ANCHOR + 1
    seen = np.lib.stride_tricks.sliding_window_view(phrase, span)
    least = seen.min(axis=1)
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[starts].view(np.int64), starts, np.r_[starts[1:], len(seen)]


def _digests(batches):
    for batch in batches:
        n, sha, found = [], [], []
        for text in batch.column("text").to_pylist():
            words = split(text)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(np.unique(anchors(words)[0]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("th"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(found, pa.list_(pa.int64()))],
            ["doc", "th", "n_words", "sha", "anchors"],
        )


def _map_of(repeated: DataFrame) -> np.ndarray:
    """Bit map of the repeated anchors."""
    spot = F.pmod("anchor", F.lit(MAP_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("anchor", F.lit(64)).cast("int"))
    found = repeated.groupBy(F.floor(spot / 64).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _postings(base: DataFrame, bits: np.ndarray) -> DataFrame:
    """``th, anchor`` of the anchors in the map."""
    shared = base.sparkSession.sparkContext.broadcast(bits)  # MAP_BITS / 8 bytes

    def run(batches):
        held = shared.value
        for batch in batches:
            lists = batch.column("anchors")
            anchor = lists.flatten().to_numpy(zero_copy_only=False)
            th = np.repeat(batch.column("th").to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()))
            keep = (held[(anchor % MAP_BITS) >> 6] >> (anchor & 63)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(th[keep]), pa.array(anchor[keep])], ["th", "anchor"])

    return base.select("th", "anchors").mapInArrow(run, "th long, anchor long")


def _stretches(hot: bool):
    """Function that cuts the stretches of each text's repeated anchors, of the hot
    or of the other ones: their words joined by one space, once with all places."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, th, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("doc", "th", "text", "repeated"))):
                words = split(text)
                codes, lo, hi = anchors(words)
                parts = {r["anchor"]: r["parts"] for r in repeated if (r["parts"] > 1) == hot}
                places: dict[tuple[int, bytes], list[int]] = {}
                for code, a, b in zip(codes.tolist(), lo.tolist(), hi.tolist()):
                    if code in parts:
                        places.setdefault((code, b" ".join(words[a : b + WINDOW - 1])), []).append(a)
                rows += [(code, parts[code], doc, th, at, stretch) for (code, stretch), at in places.items()]
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["anchor", "parts", "doc", "th", "pos", "words"])

    return run


_STRETCH = "anchor long, parts int, doc long, th long, pos array<long>, words binary"
_SPAN = "doc long, th long, first long, last long"


def _windows(numbers: list[int]) -> list[tuple[int, ...]]:
    return [tuple(numbers[i : i + WINDOW]) for i in range(len(numbers) - WINDOW + 1)]


def _numbered(stretches: list[bytes], ids: dict[bytes, int]) -> list[list[int]]:
    return [[ids.setdefault(w, len(ids)) for w in s.split(b" ")] for s in stretches]


def _automaton(phrases: dict[tuple[int, ...], int]):
    """Automaton over word numbers; each phrase carries the first document that has it."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for phrase, k in phrases.items():
        machine.add_word(phrase, k)
    machine.make_automaton()
    return machine


def _located(doc, th, pos, numbers, machine, firsts):
    """Spans of words that phrases from earlier documents cover, one stretch after the other."""
    for d, t, places, words in zip(doc, th, pos, numbers):
        found: list[list[int]] = []
        for end, k in machine.iter(tuple(words)):
            if firsts[k] < d:
                a, b = end - WINDOW + 1, end + 1
                if found and a <= found[-1][1]:
                    found[-1][1] = b
                else:
                    found.append([a, b])
        for p in places:
            for a, b in found:
                yield d, t, p + a, p + b


def _spans(rows):
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "th", "first", "last"])


def _shard(anchor, doc, th, pos, words):
    """Confirm, compile and locate for whole groups of anchors, sorted by anchor and document."""
    ids: dict[bytes, int] = {}
    numbers = _numbered(words, ids)
    seen: dict[tuple[int, ...], int] = {}
    firsts: list[int] = []
    phrases: dict[tuple[int, ...], int] = {}
    for d, line in zip(doc, numbers):
        for w in _windows(line):
            k = seen.setdefault(w, len(seen))
            if k == len(firsts):
                firsts.append(d)
            elif firsts[k] < d:
                phrases[w] = k
    if not phrases:
        return _spans([])
    return _spans(list(_located(doc, th, pos, numbers, _automaton(phrases), firsts)))


def _shards(batches):
    """Stream the sorted stretches of a partition, some whole groups at a time."""
    held = None
    names = ("anchor", "doc", "th", "pos", "words")
    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= PER_AUTOMATON:
            codes = held.column("anchor").to_numpy()
            done = int(np.searchsorted(codes, codes[-1], "left"))
            if done:
                yield _shard(*(held.column(c).slice(0, done).to_pylist() for c in names))
                held = held.slice(done).combine_chunks()
    if held is not None and held.num_rows:
        yield _shard(*(held.column(c).to_pylist() for c in names))


def _phrases(batches):
    for batch in batches:
        rows = []
        for anchor, doc, words in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc", "words"))):
            parts = words.split(b" ")
            rows += [(anchor, b" ".join(parts[i : i + WINDOW]), doc) for i in range(len(parts) - WINDOW + 1)]
        cols = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64()))], ["anchor", "phrase", "doc"])


def _hot_shard(stretches: pa.Table, confirmed: pa.Table) -> pa.Table:
    """One part of the stretches of a hot anchor against all its confirmed phrases."""
    empty = pa.Table.from_batches([_spans([])])
    if not stretches.num_rows or not confirmed.num_rows:
        return empty
    ids: dict[bytes, int] = {}
    keys = [tuple(x) for x in _numbered(confirmed.column("phrase").to_pylist(), ids)]
    machine = _automaton({k: i for i, k in enumerate(keys)})
    firsts = confirmed.column("start").to_pylist()
    numbers = _numbered(stretches.column("words").to_pylist(), ids)
    rows = list(_located(*(stretches.column(c).to_pylist() for c in ("doc", "th", "pos")), numbers, machine, firsts))
    return pa.Table.from_batches([_spans(rows)])


def spans(texts: DataFrame) -> DataFrame:
    """``doc, th, first, last``: words to remove. Anchors of more than one part are dealt to several tasks."""
    cold = (
        texts.mapInArrow(_stretches(False), _STRETCH).repartition(common.partitions(texts), "anchor")
        .sortWithinPartitions("anchor", "doc").mapInArrow(_shards, _SPAN)
    )
    with_hot = texts.where("exists(repeated, r -> r.parts > 1)")
    if with_hot.isEmpty():
        return cold
    # read more than once, and few: only these are stored
    hot = common.table(with_hot.mapInArrow(_stretches(True), _STRETCH), "stretches")
    confirmed = (
        hot.mapInArrow(_phrases, "anchor long, phrase binary, doc long")
        .groupBy("anchor", "phrase").agg(F.min("doc").alias("start"), F.max("doc").alias("end")).where("start < end")
        .join(hot.select("anchor", "parts").distinct(), "anchor")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    )
    dealt = hot.withColumn("part", F.pmod(F.xxhash64("doc", "th"), F.col("parts")).cast("int"))
    warm = (
        dealt.groupBy("anchor", "part").cogroup(confirmed.groupBy("anchor", "part"))
        .applyInArrow(_hot_shard, _SPAN)
    )
    return cold.union(warm)


def _removed(batches):
    """What is left of each text after its spans are cut out."""
    for batch in batches:
        gone, sha = [], []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = split(text)
            keep = np.ones(len(words), bool)
            for c in cuts:
                keep[c["first"] : c["last"]] = False
            gone.append(int((~keep).sum()))
            sha.append(hashlib.sha256(b" ".join([w for w, k in zip(words, keep) if k])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["th", "gone", "left_sha"])


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document.

    Of equal texts only that with the smallest id is compared with others; in
    the rest every window repeats, so all words go if there is a window at all.
    Null and empty texts have no words. A null id counts as larger than any;
    rows with equal ids are one document and take nothing from each other.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    base = common.table(
        rows.mapInArrow(_digests, "doc long, th long, n_words long, sha string, anchors array<long>"), "digests"
    )
    repeated = (
        base.select("th", F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.min("th").alias("a"), F.max("th").alias("b"), F.count("*").alias("n"))
        .where("a < b").select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    )
    repeated = common.cut(repeated)
    firsts = base.groupBy("th").agg(F.min("doc").alias("first"))
    of_text = _postings(base, _map_of(repeated)).join(repeated, "anchor").groupBy("th").agg(F.collect_set(F.struct("anchor", "parts")).alias("repeated"))
    chosen = of_text.join(firsts, "th").select(F.col("th").alias("_th"), F.col("first").alias("_doc"), "repeated")
    dealt = rows.repartition(common.partitions(docs), "th", "doc")
    texts = common.bucketed(
        dealt.join(chosen, (dealt["th"] == chosen["_th"]) & (dealt["doc"] == chosen["_doc"])).select("doc", "th", "text", "repeated"),
        "passages", ["th", "doc"],
    )
    found = spans(texts)
    cuts = found.groupBy("th", "doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    left = texts.select("doc", "th", "text").join(cuts, ["th", "doc"]).mapInArrow(_removed, "th long, gone long, left_sha string")
    left = left.groupBy("th").agg(F.max("gone").alias("gone"), F.max("left_sha").alias("left_sha"))
    all_gone = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return (
        base.select("doc", "th", "n_words", "sha").join(firsts, "th").join(left, "th", "left")
        .select(
            F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_words",
            F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"),
        )
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), early AS (
  SELECT t, min(doc_id) AS m FROM win GROUP BY t HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN early USING (t) WHERE m < doc_id
), word AS (
  SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

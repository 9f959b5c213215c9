"""SimHash, repeated passages and decontamination against brute force, and odd input."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chatlens.llm import decontamination, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def plain_components(codes, bits):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(codes))]


def same_groups(a, b):
    return len({*a}) == len({*b}) == len({*zip(a, b)})


def test_fingerprints(documents):
    rows = documents.orderBy("doc_id").limit(60).collect()
    for r in rows:
        assert simhash.fingerprint(r.text) & (1 << 64) - 1 == plain_fingerprint(r.text, 4)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0
    assert simhash.fingerprint("A b") & (1 << 64) - 1 == plain_fingerprint("a b", 4)


def test_near_groups(documents):
    rows = simhash.near_groups(documents).collect()
    groups = plain_components([int(r.fingerprint, 16) for r in rows], 4)
    smallest = {}
    for g, r in zip(groups, rows):
        smallest[g] = min(smallest.get(g, r.doc_id), r.doc_id)
    assert [smallest[g] for g in groups] == [r.component_id for r in rows]


def scattered(n, family, seed):
    rng = random.Random(seed)
    codes = {rng.getrandbits(64) for _ in range(n)}
    centre = rng.getrandbits(64)
    for _ in range(family):  # a dense family, and a chain that leads away from it
        codes.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    for _ in range(12):
        centre ^= sum(1 << b for b in rng.sample(range(64), 4))
        codes.add(centre)
    return sorted(codes)


@pytest.mark.parametrize("segments", [5, 6, 7, 8])
def test_links_lose_nothing(spark, monkeypatch, segments):
    codes = scattered(400, 200, segments)
    monkeypatch.setattr(simhash, "plan_segments", lambda n, max_bits: segments)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    got = {r.fp: r.root for r in simhash.grouped(df).collect()}
    mine = [got[c - (1 << 64) if c >> 63 else c] for c in codes]
    assert same_groups(mine, plain_components(codes, 4))


def signed(c):
    return c - (1 << 64) if c >> 63 else c


@pytest.mark.parametrize("unlinked", [1 / 8, 0])
def test_big_groups_are_keyed_again(spark, monkeypatch, unlinked):
    monkeypatch.setattr(simhash, "BIG_GROUP", 50)
    monkeypatch.setattr(simhash, "UNLINKED", unlinked)  # 0: linked groups as well
    rng = random.Random(5)
    codes = {rng.getrandbits(40) << 24 | 0xABCDEF for _ in range(400)}  # these agree in 24 bits
    codes |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for c in list(codes)[:150]}
    codes |= set(scattered(100, 60, 2))
    codes = sorted(codes)
    df = spark.createDataFrame([(signed(c),) for c in codes], "fp long")
    got = {r.fp: r.root for r in simhash.grouped(df).collect()}
    assert same_groups([got[signed(c)] for c in codes], plain_components(codes, 4))


def test_big_groups_are_not_held():
    rng = random.Random(6)
    x = np.array(sorted({rng.getrandbits(50) << 14 for _ in range(30_000)}), np.uint64)
    key = np.zeros(len(x), np.int64)
    batches = [simhash._rows(x[i : i + 5000], None, key[i : i + 5000], (1 << 64) - (1 << 14)) for i in range(0, len(x), 5000)]
    out = list(simhash._compared(iter(batches), 4, False))
    again = [b for b in out if b.column("b").null_count]
    assert sum(len(b) for b in again) == 70 * len(x) and max(len(b) for b in out) <= simhash.BIG_GROUP + 5000
    groups = np.unique(np.concatenate([b.column("key").to_numpy() for b in again]), return_counts=True)[1]
    assert groups.max() < 50
    assert not any(b.column("b").null_count for b in simhash._compared(iter(batches[:1]), 4, True))


def test_dense_groups_give_few_links():
    codes = np.array(scattered(0, 3000, 1), np.uint64)
    a, b = simhash._group_links(np.zeros(len(codes), np.int64), codes, 4)
    assert len(a) < len(codes) and np.all(np.bitwise_count(a ^ b) <= 4)


def test_finer_segments_for_more_rows():
    plans = [simhash.plan_segments(10**k) for k in range(2, 12)]
    assert plans == sorted(plans) and plans[0] == 5 and plans[-1] >= 8


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_one_of_each(documents, odd, none):
    kept = [r.doc_id for r in simhash.one_of_each(documents).collect()]
    assert sorted(kept) == sorted({r.component_id for r in simhash.near_groups(documents).collect()})
    few = simhash.one_of_each(odd)
    assert few.columns == odd.columns
    # empty, blank and null texts are one group: fingerprint zero
    assert sorted((r.doc_id for r in few.collect()), key=str) == [1, 3, 6, 7, 8, None] or few.where("doc_id = 3").count() == 1
    assert simhash.near_groups(none).count() == simhash.one_of_each(none).count() == 0
    assert simhash.near_groups(odd).count() == odd.count()


def plain_removal(rows, window):
    """``{row number: (words, removed, sha)}`` by looking every window up."""
    last = 1 << 70
    texts = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, w in texts:
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == last else d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 40, 12)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 20))] + rng.choice(shared)
        rows.append((d if d % 9 else None, " ".join(text)))
    return rows + rows[:5] + [(70, "a a " * 30), (71, "a a " * 20), (72, None), (73, "")]


@pytest.mark.parametrize("hot", [substrings.HOT, 4])
def test_removal(spark, hot):
    rows = passages(hot)
    got = substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(rows, 13)


def test_small_automata(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PER_AUTOMATON", 5)
    rows = passages(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substrings.deduplicated(df).collect()), key=str) == plain_removal(rows, 13)


def test_removal_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = substrings.deduplicated(odd).collect()
    assert sorted(map(tuple, got), key=str) == plain_removal(rows, 13)
    assert substrings.deduplicated(none).count() == 0


def plain_hits(docs, items, window):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def split(t):
        return token.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = {}
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[k]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "One two THREE, four"), (2, "four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "é!"),
         (3, None), (4, "..."), (5, "one two three four"), (2, "ab cd"), (7, "x x x x x x x x x x x")]


@pytest.mark.parametrize("most", [decontamination.MAX_PREFIXES, 1])
@pytest.mark.parametrize("items", [ITEMS, [i for i in ITEMS if i[0] != 10], []])
def test_hits(spark, odd, monkeypatch, most, items):
    monkeypatch.setattr(decontamination, "MAX_PREFIXES", most)
    if most == 1:  # a bit map with few slots, which lets other tokens pass
        monkeypatch.setattr(decontamination, "MAX_TOKENS", 1)
        monkeypatch.setattr(decontamination, "MAP_SLOTS", 4)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 6]
    rows += [(20, "x " * 25), (21, "ab-cd ab cd"), (22, "zero one two three four five six seven eight nine ten eleven twelve thirteen x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == plain_hits(rows, items, 10)
    clean = decontamination.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, *_, bad in plain_hits(rows, items, 10) if not bad), key=str)


@pytest.mark.parametrize("most", [decontamination.MAX_PREFIXES, 1])
def test_texts_that_start_inside_a_window(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_PREFIXES", most)
    item = "a b c d e f g h i j k".split()
    rows = [(i, " ".join(item[i:])) for i in range(11)] + [(20 + i, " ".join(item[:i])) for i in range(11)]
    rows += [(50 + i, "a b c d e f " * 3) for i in range(3)]  # the rarest shingle stands late in the window
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontamination.report(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == plain_hits(rows, [(1, " ".join(item))], 10)


def test_short_items_do_not_shorten_other_keys(spark, monkeypatch):
    seen = []
    plain = decontamination._exploded
    monkeypatch.setattr(decontamination, "_exploded", lambda rows, kept, k: seen.append(k) or plain(rows, kept, k))
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "c"), (2, "a b c d e f g h i j k")], "item_id long, text string")
    row = decontamination.report(docs, bench).first()
    assert (row.n_hit, row.n_items) == (11, 2)
    assert sorted(seen) == [1, 1, 1, 2, 2, 2]  # the windows and two passes over the documents for each length of key


def test_decontamination_is_native_and_narrow(spark, documents, sf, capsys):
    decontamination.report(documents, spark.read.parquet(f"{sf}/benchmark.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan) and re.search("ReadSchema: struct<doc_id:bigint,text:string>", plan)
    assert F is not None

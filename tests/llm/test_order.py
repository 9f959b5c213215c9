"""Mixing and sharding: laws that hold whatever the data, and odd input."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chatlens.llm import common, mixing, sharding


def sized(docs):
    return docs.select("doc_id", "source", common.word_count(F.col("text")).alias("size"))


def test_word_count(spark):
    rows = [("a b",), (" a\x0bb ",), ("",), (None,), (" ",), ("a b c",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(common.word_count(F.col("t"))).collect()]
    assert got == [2, 2, 0, 0, 1, 2]


def test_ranks_within_and_overall(spark):
    df = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(500)], "i long, g string")
    got = common.ranked(df, [F.col("g"), F.col("i").desc()], "g", "k").collect()
    for g in "ab":
        of = sorted((r.i for r in got if r.g == g), reverse=True)
        assert {r.i: r.k for r in got if r.g == g} == {i: k for k, i in enumerate(of)}
    whole = common.ranked(df, [F.col("i")], None, "k").collect()
    assert all(r.k == r.i for r in whole)


def test_targets_share_out_by_weight(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    weights, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 100, "b": 1000, "c": 10, "d": 0, None: 500}
    full, left = set(), 1.5 * 1610
    while True:  # cut off what is too much, share it out again
        level = (left - sum(2 * size[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        over = {s for s in weights if s not in full and weights[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2.0 * size[s] if s in full else weights[s] * level for s in weights}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(documents):
    rows = mixing.copies(sized(documents)).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-3


def test_mix_does_not_depend_on_layout(documents):
    one = sorted((r.doc_id, r.copies) for r in mixing.copies(sized(documents.repartition(3))).collect())
    assert one == sorted((r.doc_id, r.copies) for r in mixing.copies(sized(documents.coalesce(1))).collect())


def test_mix_keeps_columns_and_odd_rows(odd, none):
    out = mixing.mix(odd)
    assert out.columns == odd.columns and out.where("doc_id = 6").count() <= 2
    assert mixing.mix(none).count() == 0
    assert mixing.copies(sized(odd)).count() == odd.count()


def test_shards_match_the_mixture(documents):
    n = 10
    rows = sharding.interleaved(documents.select("doc_id", "source"), n).collect()
    total, by, slots = Counter(r.source for r in rows), defaultdict(Counter), defaultdict(list)
    for r in rows:
        by[r.shard][r.source] += 1
        slots[r.shard].append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(by[k][s] - total[s] / n) <= 2 for k in range(n) for s in total)


def test_shards_of_odd_rows(odd, none):
    out = sharding.shard_documents(odd, 3)
    assert out.count() == odd.count() and out.columns[-2:] == ["shard", "slot"]
    sizes = Counter(r.shard for r in out.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sharding.shard_documents(none).count() == 0

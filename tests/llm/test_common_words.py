"""References of languages whose words have more than five bytes."""

import random

from chatlens.llm import quality_rules


def test_word_salad_in_cyrillic_is_dropped(spark):
    rng = random.Random(3)
    common = ["если", "когда", "потому", "который", "также", "после", "между", "через"]
    letters = "абвгдежзиклмнопрстуфхцчшэюя"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    good = [" ".join(rng.choice(common) if k % 2 else word() for k in range(300)) for _ in range(40)]
    salad = " ".join(word() for _ in range(300))
    docs = spark.createDataFrame([(i, t, "ru") for i, t in enumerate([*good, salad])], "doc_id long, text string, lang string")
    refs = quality_rules.references(docs)
    assert {w.encode() for w in common} <= set(refs["ru"][1])
    kept = {r.doc_id: r.kept for r in quality_rules.judged(docs, refs).collect()}
    assert all(kept[i] for i in range(40)) and not kept[40]


def test_a_language_called_like_the_reference_of_all_has_its_own(spark):
    rows = [(i, lang, word * 60) for i, (lang, word) in enumerate([("*", "uno due "), ("en", "one two "), (None, "eins zwei ")])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    refs = quality_rules.references(docs)
    assert sorted(refs) == ["*", "**", "en"]
    assert set(refs["**"][1]) == {b"uno", b"due"} and len(refs["*"][1]) == 6
    got = {r.doc_id: r.word_distance for r in quality_rules.judged(docs, refs).collect()}
    assert got[0] == got[1] == 0 and got[2] > 0

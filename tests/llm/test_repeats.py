"""Toxicity where a text uses the same telling words several times."""

import math

from chatlens.llm import toxicity

WORDS = (b"vile", b"scum", b"filth")
MODEL = {"scores": dict.fromkeys(WORDS, 3.0), "drift": -0.3, "k": 0.01, "a": -3.0, "b": 1.0, "lambda": 1.0}
PASSAGE, CALM = "vile scum filth", "calm " * 60


def scored(spark, *texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in toxicity.scored(frame, MODEL).orderBy("doc_id").collect()]


def test_equal_passages_are_all_reported(spark):
    (row,) = scored(spark, f"{CALM}{PASSAGE} {CALM}{PASSAGE} {CALM}{PASSAGE}")
    assert [(p.first, p.text) for p in row.passages] == [(60, PASSAGE), (123, PASSAGE), (186, PASSAGE)]
    assert all(math.isclose(p.score, 9.0) for p in row.passages)


def test_stray_words_do_not_damp_a_later_passage(spark):
    stray = "".join(f"{w.decode()} {CALM}" for w in WORDS)
    with_stray, without = scored(spark, f"{stray}{PASSAGE}", f"{'calm ' + CALM}" * 3 + PASSAGE)
    assert [p.text for p in with_stray.passages] == [p.text for p in without.passages] == [PASSAGE]
    assert math.isclose(with_stray.score, without.score) and with_stray.score >= toxicity.THRESHOLD

"""Typed parts through the formatted chat and back, and rows that need a rule."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chatlens.llm import chat_format as cf

MESSAGES = f"conv_id long, turn long, role string, parts {cf.PARTS}"
PIECES = ["<|", "|>", "<|image|>", "<\\|image|>", "<\\\\|end|>", "<", "[", "/INST]", "[INST]", "</s>", "<s>", "\\", "a b", "\n", "é\U0001f600",
          "<|turn|>", "<|body|>x", "<|part|>", "|", "<|<|end|>|>", "", "[\\INST]", "$1"]


def part(kind="text", text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def plain(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return frame.withColumn("parts", cf.text_part(F.col("text")))


def test_control_strings_come_back(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(8))) for _ in range(400)]
    rows = [(i // 8, i % 8, rng.choice(["user", "assistant", "<|end|>", "a\nb"]), t) for i, t in enumerate(texts)]
    chats = cf.format_chats(plain(spark, rows)).cache()
    for chat in chats.collect():
        assert chat.formatted.count(cf.TURN) == chat.formatted.count(cf.END) == chat.n_turns
        assert not any(mark in chat.formatted for mark in ("</s>", "[INST]", "<|image|>"))
    read = {(r.conv_id, r.i): r for r in cf.read_turns(chats).withColumn("text", cf.unescaped(F.col("body"))).collect()}
    for conv, turn, role, text in rows:
        got = read[conv, turn]
        assert (got.role, got.text, got.learned) == (role, text, text if role == "assistant" else "")


def test_parts_come_back_in_order(spark):
    parts = [part(text="see <|im"), part(text="age|> and"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b", seconds=1.5),
             part(text="tail </s>"), part("document", ref="c", pages=2), part("image", ref=None), part("hologram", ref="d"), part(None, text="x y")]
    frame = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", parts[2:5])], MESSAGES)
    chat = cf.format_chats(frame).first()
    got = [(a.kind, a.ref, a.tokens) for a in chat.attachments]
    want = [("image", "a.png", 3), ("audio", "b", 38), ("document", "c", 2048), ("image", None, 256), ("document", "d", 256)]
    assert got == want + want[:2]
    assert chat.n_tokens == sum(t for *_, t in got) + 2 + 2 + 2 + 2 + 2  # words of the five text parts
    marks = [chat.formatted.count(f"<|{k}|>") for k in cf.KINDS]
    assert marks == [3, 2, 2]
    back = cf.read_turns(cf.format_chats(frame)).withColumn("parts", cf.read_parts(F.col("body"))).orderBy("i").collect()
    assert [(p.type, p.text) for p in back[0].parts] == [
        ("text", "see <|im"), ("text", "age|> and"), ("image", None), ("audio", None), ("text", "tail </s>"),
        ("document", None), ("image", None), ("document", None), ("text", "x y")]
    assert back[1].learned == "tail </s>"  # the mask leaves placeholders out


def test_odd_rows(spark):
    long = "word </s> " * 200_000
    rows = [(1, None, "assistant", None), (1, 2, None, "b"), (1, 2, None, "b"), (1, 1, "user", ""), (None, 0, "assistant", "x"), (None, None, None, None),
            (2, 0, "assistant", long)]
    frame = plain(spark, rows).withColumns({"piece": F.lit("p"), "at": F.lit(1), "seen": F.lit("s"), "tokens": F.lit(0)})
    got = {r.conv_id: r for r in cf.digests(cf.format_chats(frame)).collect()}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert got[1].turns_sha256 == sha("assistant\n\n" + "user\n\n" + "\nb\n" * 2) and got[1].n_turns == 4
    assert got[None].turns_sha256 == sha("\n\nassistant\nx\n") and got[None].loss_chars == 1
    assert (got[2].loss_chars, got[2].loss_sha256) == (len(long), sha(long))
    empty = spark.createDataFrame([(1, 0, "user", None), (1, 1, "user", [])], MESSAGES)
    assert cf.digests(cf.format_chats(empty)).first().n_turns == 2
    assert cf.digests(cf.format_chats(empty.limit(0))).count() == 0


@pytest.mark.parametrize("step", [cf.format_chats, lambda m: cf.digests(cf.format_chats(m))])
def test_stays_native(spark, sf, step):
    frame = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("parts", cf.text_part(F.col("text")))
    plan = step(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert plan.count("Exchange hashpartitioning(conv_id") == 1

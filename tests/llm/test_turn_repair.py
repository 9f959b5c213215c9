"""Repaired conversations against a search over all edits, in any block length."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chatlens.llm import turn_repair as tr

WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else text
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows):
    """(cost, letters, repaired) by uniform-cost search over (rows done, what the grammar expects)."""
    heap, done = [(0, "", 0, "start", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("start", "a"):
            return cost, audit, out
        follow = "assistant" if state == "u" else "user"

        def push(letter, price, j, role=None, text=""):
            if role is None:
                heapq.heappush(heap, (cost + price, audit + letter, j, state, out))
            else:
                heapq.heappush(heap, (cost + price, audit + letter, j, role[:1], (*out, f"{role}:{text}")))

        push("I", 2, i, follow)
        if i < len(rows):
            role, text, fault = rows[i]
            push("D", 3, i + 1)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                push("R", 2 + extra, i + 1, follow, text)
                if (state, role[:1]) in {("start", "s"), ("start", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    push("K", extra, i + 1, role, text)


def by_hand(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, fixed = cheapest(marked)
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{c: sum(m[2] == c for m in marked) for c in ("blank", "duplicate", "truncated")},
            "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(fixed).encode()).hexdigest(),
        }
    return out


def check(got, want):
    got = [r.asDict() for r in got]
    assert len(got) == len(want)
    for row in got:
        assert row == want[row["conv_id"]]


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(tr.op12(spark, sf).collect(), by_hand(rows, list(damage(rows))))


@pytest.fixture(scope="module")
def wild():
    """Many faults, unknown roles, nulls, equal turns, repeated rows; one long conversation."""
    rng = random.Random(11)
    texts = ["a.", "b!", "c", "", " \t", None, "d? ", "e", "\x0b", "é.", "x y z."]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 14)):
            rows.append((conv, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "user"]), rng.choice(texts)))
    rows += [(99, i, "user" if i % 2 == 0 or i % 13 == 0 else "assistant", f"text {i // 2 if i % 7 == 0 else i}" + "." * (i % 5 > 0)) for i in range(300)]
    return rows + rows[:20]


@pytest.mark.parametrize("block", [1024, 7, 1])
def test_any_block_length(spark, wild, monkeypatch, block):
    monkeypatch.setattr(tr, "ROWS_PER_BLOCK", block)
    tr._solved.cache_clear()
    frame = spark.createDataFrame(wild, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("pos", "kind", "block", "th", "first", "code", "state", "_n", "_run")})
    original = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in wild]
    check(tr.report(frame).collect(), by_hand(wild, original))
    check(tr.report(tr.damaged(frame), frame).collect(), by_hand(wild, list(damage(wild))))


def test_repaired_rows(spark, wild):
    frame = spark.createDataFrame(wild, "conv_id long, turn long, role string, text string")
    found = {}
    for r in tr.repaired(frame).orderBy("conv_id", "place").collect():
        found.setdefault(r.conv_id, []).append(r)
    for row in tr.report(frame).collect():
        rows = found.get(row.conv_id, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == row.repaired_sha256
        assert "".join(r.edit for r in rows) == row.audit.replace("D", "")
        assert [r.place for r in rows] == list(range(len(rows)))


def test_empty_and_lost_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tr.report(frame).count() == 0 and tr.repaired(frame).count() == 0
    ids = spark.createDataFrame([(5,), (None,)], "conv_id long")
    for r in tr.report(frame, ids).collect():
        assert (r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_prices_are_settled_in_linear_time():
    """Every node is looked at a bounded number of times, also where all rows are illegal."""
    import time

    def took(n):
        start = time.perf_counter()
        tr.settle(tr._code("u", "") * n, (0, 4, 2, 0))
        return time.perf_counter() - start

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.01)

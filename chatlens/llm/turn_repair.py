"""Conversation structure repair by an auction shortest-path algorithm.

A conversation is a lattice: a node is (rows done, state of the role grammar
``(s?(ua)+)?``), an arc an edit with an integer cost. The auction keeps a path
and a price for every node. The end of the path raises its price to the best
offer of its arcs and falls back (contraction), or, where its price equals that
offer, takes the arc (extension). Origins are taken from the far end of the
lattice, and a path stops at the first node that an earlier path settled, so
every node is settled after a bounded number of steps. The prices are then the
cheapest costs to go; the tight arcs are those of all cheapest paths, and among
them the letters are traced in ASCII order.

Rows are numbered within their conversation and cut into blocks. Blocks are
solved by themselves for each state that they may leave in; prices are chained
over the blocks from the last one, edits from the first one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm import common

ROWS_PER_BLOCK = 1024
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
INF = 1 << 60

#: States: nothing yet, after s, after u, after a. Role initials, x for any other; then faults.
STATES = range(4)
INITIALS = "suax"
FAULTS = ("", "blank", "duplicate", "truncated")
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
#: What an inserted or changed row is: the one role that may follow.
_ROLE = ("user", "user", "assistant", "user")
_AFTER = (2, 2, 3, 2)
_LEGAL = {"su", "ua", "au"}
#: Edits that finish the grammar, by state, and their cost: the prices of the ends.
_TAIL = ("", "II", "I", "")
_ENDS = tuple(INSERT * len(t) for t in _TAIL)


def _code(initial: str, fault: str) -> str:
    return chr(ord("a") + INITIALS.index(initial) * len(FAULTS) + FAULTS.index(fault))


def _arcs(initial: str, fault: str, state: int):
    """(letter, cost, rows done, next state) of each edit, in ASCII order of the letters."""
    extra = TRUNCATED if fault == "truncated" else 0
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, _AFTER[state])]
    if fault not in ("blank", "duplicate"):
        if state in _NEXT[initial]:
            arcs.append(("K", extra, 1, _NEXT[initial][state]))
        arcs.append(("R", REROLE + extra, 1, _AFTER[state]))
    return arcs


_ARCS = {_code(i, f): [_arcs(i, f, q) for q in STATES] for i in INITIALS for f in FAULTS}
_LEAST = {code: min(cost for arcs in of for _, cost, done, _ in arcs if done) for code, of in _ARCS.items()}


def settle(pattern: str, ends) -> list[list[int]]:
    """Prices of all nodes: ``prices[i][state]`` is the cheapest cost from there, ``ends`` those after the last row."""
    prices = [[] for _ in pattern] + [list(ends)]
    # inserts go round between the last two states; with no end there, two prices would outbid each other for ever
    lost = [q > 1 and min(ends[2:]) >= INF for q in STATES]
    settled = [list(lost) for _ in pattern] + [[True] * 4]
    for i in range(len(pattern) - 1, -1, -1):
        arcs, low = _ARCS[pattern[i]], min(prices[i + 1]) + _LEAST[pattern[i]]
        prices[i] = [INF if lost[q] else min(low, INF) for q in STATES]  # no arc costs less than the prices fall along it
        for origin in STATES:
            path = [(i, origin)]
            while True:
                at, state = path[-1]
                if settled[at][state]:
                    break
                offer, to = INF, None
                for _, cost, done, after in arcs[state]:
                    total = cost + prices[at + done][after]
                    if total < offer:
                        offer, to = total, (at + done, after)
                if to is None:  # no way to the end from here
                    prices[at][state], settled[at][state] = INF, True
                    if len(path) > 1:
                        path.pop()
                elif prices[at][state] < offer:
                    prices[at][state] = offer
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for at, state in path:
                settled[at][state] = True
    return prices


def trace(pattern: str, prices, state: int) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from ``state``, and the state they leave in."""
    i, out = 0, []
    if prices[0][state] >= INF:
        return "", state
    while i < len(pattern):
        for letter, cost, done, after in _ARCS[pattern[i]][state]:
            if cost + prices[i + done][after] == prices[i][state]:
                out.append(letter)
                i, state = i + done, after
                break
    return "".join(out), state


@lru_cache(maxsize=50_000)
def _solved(pattern: str, ends: tuple) -> tuple[list[str], list[int], list[int]]:
    """Letters, last states and prices for each first state."""
    prices = settle(pattern, ends)
    ways = [trace(pattern, prices, q) for q in STATES]
    return [w[0] for w in ways], [w[1] for w in ways], prices[0]


def _tables(batches, schema, row):
    """Arrow batches of ``schema`` from one dict for each input row."""
    for batch in batches:
        yield pa.RecordBatch.from_pylist([row(r) for r in batch.to_pylist()], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (field.split(" ") for field in schema.split(", "))])


_COUNTS = ("blank", "duplicate", "truncated")
_BLOCK = "conv_id long, block long, pattern string, blank long, duplicate long, truncated long, lo long, hi long, n_turns long"
_PASSED = _BLOCK + ", passage array<long>"
_PRICED = _BLOCK + ", seam long, ends array<long>"
_TRACED = _BLOCK + ", seam long, illegal long, letters array<string>, states array<long>, cost long"


def _passages(batches):
    """For blocks of a longer conversation: the cost from each first to each last state."""
    def row(r):
        alone = r["block"] == 0 and len(r["pattern"]) < ROWS_PER_BLOCK
        unit = [] if alone else [_solved(r["pattern"], tuple(0 if q == end else INF for q in STATES))[2] for end in STATES]
        return r | {"passage": [unit[end][q] for q in STATES for end in STATES] if unit else []}

    yield from _tables(batches, _arrow(_PASSED), row)


def _chained():
    """Blocks of a conversation from the last to the first: each gets the prices after it.

    ``seam`` counts an illegal pair across the border to the next block (1) and
    a turn number on both sides (2).
    """
    def run(batches):
        held = {"conv": object()}

        def row(r):
            if r["conv_id"] != held["conv"]:
                held.update(conv=r["conv_id"], ends=list(_ENDS), first="", lo=None)
            out, ends = dict(r), held["ends"]
            passage = out.pop("passage")
            same = 2 if r["hi"] is not None and r["hi"] == held["lo"] else 0
            pair = r["pattern"][-1:] + held["first"]
            out.update(ends=ends, seam=same + (len(pair) == 2 and not _legal(pair)))
            if passage:
                held["ends"] = [min(INF, min(passage[4 * q + e] + ends[e] for e in STATES)) for q in STATES]
            held.update(first=r["pattern"][:1], lo=r["lo"])
            return out

        yield from _tables(batches, _arrow(_PRICED), row)

    return run


def _initial(code: str) -> str:
    return INITIALS[(ord(code) - ord("a")) // len(FAULTS)]


def _legal(pair: str) -> bool:
    return _initial(pair[0]) + _initial(pair[1]) in _LEGAL


def _traces(batches):
    def row(r):
        out = dict(r)
        letters, states, prices = _solved(r["pattern"], tuple(out.pop("ends")))
        illegal = sum(not _legal(a + b) for a, b in pairwise(r["pattern"]))
        return out | {"letters": letters, "states": states, "illegal": illegal, "cost": prices[0]}

    yield from _tables(batches, _arrow(_TRACED), row)


def facts(messages: DataFrame) -> DataFrame:
    """Narrow rows: ``conv_id, turn, role, th, copy, initial, fault``; ``th`` is the hash of the text."""
    bare = F.rtrim("text", F.lit(WHITE))
    fault = F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    return messages.select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("th"), "copy",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"),
    )


_ORDER = ("turn", "role", "th", "copy")


def blocks(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each block of a conversation: its pattern, one letter for each row, and its counts.

    A block holds ``ROWS_PER_BLOCK`` rows at most, however long the conversation.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), *[F.col(c) for c in _ORDER[1:]]]
    placed = common.cut(common.ranked(facts(messages), order, "conv_id", "pos"))
    firsts = placed.groupBy("conv_id", "role", "th").agg(F.min("pos").alias("first"))
    firsts = firsts.select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "role", "th")], "first")
    seen = placed.join(
        firsts, placed["conv_id"].eqNullSafe(firsts["f_conv_id"]) & (placed["role"] == firsts["f_role"])
        & (placed["th"] == firsts["f_th"]) & (placed["pos"] == firsts["first"]), "left",
    )
    fault = F.when((F.col("fault") != "blank") & F.col("first").isNull(), "duplicate").otherwise(F.col("fault"))
    codes = F.create_map(*[F.lit(x) for i in INITIALS for f in FAULTS for x in (f"{i}{f}", _code(i, f))])
    rows = seen.withColumn("fault", fault).select(
        "conv_id", F.expr(f"pos div {ROWS_PER_BLOCK}").alias("block"), "pos", "turn", "fault",
        F.element_at(codes, F.concat("initial", "fault")).alias("code"),
    )
    empty = ids.select("conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("pos", "long"), ("turn", "long"), ("fault", "string"), ("code", "string"))])
    held = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("pos", "code", "turn"))))
    return rows.unionByName(empty).groupBy("conv_id", "block").agg(
        held.alias("held"), *[F.count_if(F.col("fault") == c).alias(c) for c in _COUNTS],
        F.min("turn").alias("lo"), F.max("turn").alias("hi"),
    ).select(
        "conv_id", "block", F.array_join("held.code", "").alias("pattern"), *_COUNTS, "lo", "hi",
        F.size(F.array_distinct(F.array_compact("held.turn"))).cast("long").alias("n_turns"),
    )


def traced(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks with their letters for each state that they may start in."""
    n = common.partitions(messages)
    passed = blocks(messages, ids).mapInArrow(_passages, _PASSED)
    back = passed.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    priced = back.mapInArrow(_chained(), _PRICED)
    return priced.repartition(n, "conv_id", "block").mapInArrow(_traces, _TRACED)


def _walk(batches):
    """Conversations in order: ("block", row), ("row", conversation, role, text, letter) and ("end", totals) events.

    The block rows of a conversation come before its texts. What is held is
    its letters, which are part of the result, never its texts.
    """
    conv, totals, letters, state, at, role_state = object(), None, [], 0, 0, 0

    def finish():
        nonlocal role_state
        for _ in range(len(audit) - at):
            yield "row", totals["conv_id"], _ROLE[role_state], "", "I"
            role_state = _AFTER[role_state]
        totals["audit"] = audit
        yield "end", totals

    audit = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if totals is not None:
                    audit = "".join(letters) + _TAIL[state] if audit is None else audit
                    yield from finish()
                conv, letters, state, at, role_state, audit = r["conv_id"], [], 0, 0, 0, None
                totals = {"conv_id": conv, "lo": None, "hi": None, "n_turns": 0, "illegal": 0, "cost": 0} | dict.fromkeys(_COUNTS, 0)
            if r["kind"] == 0:
                if r["block"] == 0:
                    totals["cost"] = r["cost"]
                for c in _COUNTS:
                    totals[c] += r[c]
                totals["illegal"] += r["illegal"] + r["seam"] % 2
                totals["n_turns"] += r["n_turns"] - r["seam"] // 2
                for c, pick in (("lo", min), ("hi", max)):
                    both = [x for x in (totals[c], r[c]) if x is not None]
                    totals[c] = pick(both) if both else None
                letters.append(r["letters"][state])
                state = r["states"][state]
                continue
            if audit is None:
                audit = "".join(letters) + _TAIL[state]
            while audit[at] == "I":
                yield "row", conv, _ROLE[role_state], "", "I"
                role_state, at = _AFTER[role_state], at + 1
            letter, at = audit[at], at + 1
            if letter == "K":
                yield "row", conv, r["role"], r["text"], "K"
                role_state = _NEXT[r["role"][0]][role_state]
            elif letter == "R":
                yield "row", conv, _ROLE[role_state], r["text"], "R"
                role_state = _AFTER[role_state]
    if totals is not None:
        audit = "".join(letters) + _TAIL[state] if audit is None else audit
        yield from finish()


def _in_order(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """The traces of a conversation, then its texts, side by side in one partition. Texts move here only."""
    control = traced(messages, ids).drop("pattern").withColumn("kind", F.lit(0))
    texts = messages.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("th"), "copy", "text", F.lit(1).alias("kind"))
    both = control.unionByName(texts, allowMissingColumns=True).repartition(common.partitions(messages), "conv_id")
    return both.sortWithinPartitions("conv_id", "kind", "block", F.col("turn").asc_nulls_first(), *_ORDER[1:]).drop("th", "copy")


def _prepared(messages: DataFrame) -> DataFrame:
    space = F.lit(" ")
    copy = F.col("copy") if "copy" in messages.columns else F.lit(0)
    return messages.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), copy.cast("int").alias("copy"))


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_CHUNK = 5_000


def _reports(batches):
    schema, out, digest, first = _arrow(_REPORT), [], hashlib.sha256(), True
    for event in _walk(batches):
        if event[0] == "row":
            digest.update((("" if first else "\n") + event[2] + ":" + event[3]).encode("utf-8", "surrogatepass"))
            first = False
            continue
        t = event[1]
        gaps = 0 if t["lo"] is None else t["hi"] - t["lo"] + 1 - t["n_turns"]
        out.append({k: t[k] for k in ("conv_id", *_COUNTS, "illegal", "cost", "audit")} | {"gaps": gaps, "repaired_sha256": digest.hexdigest()})
        digest, first = hashlib.sha256(), True
        if len(out) >= _CHUNK:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


_REPAIRED = "conv_id long, place long, role string, text string, edit string"


def _repaired(batches):
    schema, out, place = _arrow(_REPAIRED), [], 0
    for event in _walk(batches):
        if event[0] == "end":
            place = 0
            continue
        out.append(dict(zip(schema.names, (event[1], place, *event[2:]))))
        place += 1
        if len(out) >= _CHUNK:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def repaired(messages: DataFrame) -> DataFrame:
    """The rows of every repaired conversation: ``conv_id, place, role, text, edit`` (K, R or I).

    ``messages`` has ``conv_id, turn, role, text``; other columns are not read,
    but a column ``copy`` orders rows that are equal otherwise. Rows stand by
    turn, nulls first, equal turns by role and content. A null role or text is
    one space, so it can only be given a role or, as blank, deleted; messages
    without ``conv_id`` are one conversation. A row is blank without any
    character but white space, a duplicate if role and text stood earlier in
    the conversation, truncated if it ends in none of ``.!?``. Repeated rows are
    duplicates, an empty table gives none.
    """
    rows = _prepared(messages)
    return _in_order(rows, rows.select("conv_id").distinct()).mapInArrow(_repaired, _REPAIRED)


def report(messages: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: its faults, the cost and letters of its cheapest edits, a digest of the result.

    Rows as in ``repaired``. ``ids`` names conversations that are reported
    even if they have no row.
    """
    rows = _prepared(messages)
    ids = (rows if ids is None else ids).select("conv_id").distinct()
    return _in_order(rows, ids).mapInArrow(_reports, _REPORT)


def damaged(messages: DataFrame) -> DataFrame:
    """Rows with faults by the checksum of ``conv_id:turn``: dropped, emptied, cut, repeated or of another role."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")), F.lit(20))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(as_text("text"), "[.!?]", "")).otherwise(as_text("text"))
    return messages.withColumn("kind", kind).where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(as_text("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return report(damaged(rows), rows)

"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatlens.llm import common

#: Labelled documents to fit on, about; all of them if there are fewer.
MAX_TRAIN = 12_000
#: Dirichlet prior of a word: a flat part, and a part by background frequency, as a share of all counts.
FLAT_PRIOR = 0.5
PRIOR_SHARE = 0.002
#: Root of the likelihood ratio against equal use that a word must reach to count, and its toxic documents.
MIN_Z = 4.5
MIN_TOXIC = 4
THRESHOLD = 0.5
#: Chance of so high a segment in a clean text below which a passage is reported.
PASSAGE_P = 0.01

#: Bytes of the word beginnings that count as tokens beside the word, so that inflected forms share evidence.
STEMS = (4, 5, 6, 7)
#: Surprise (in nats) beyond which a segment is no stronger evidence.
MAX_SURPRISE = 12.0
#: Words whose score a task remembers.
CACHE = 500_000

def with_stems(words) -> set[bytes]:
    """The words and their proper beginnings, marked by a star."""
    out = set(words)
    for k in STEMS:
        out.update([w[:k] + b"*" for w in out if len(w) > k and w[-1:] != b"*"])
    return out


class WordScores(dict):
    """Score of a word: its own, or that of its longest telling beginning; None if nothing tells."""

    def __init__(self, telling: dict[bytes, float]):
        self.telling = telling

    def __missing__(self, word: bytes):
        score = self.telling.get(word)
        for k in reversed(STEMS):
            if score is not None:
                break
            if len(word) > k:
                score = self.telling.get(word[:k] + b"*")
        if len(self) >= CACHE:
            self.clear()
        self[word] = score
        return score


def segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, score)`` in linear time.

    ``positions`` are those of tokens with a score of their own, all others score
    ``drift`` (not above zero). Each new positive token joins the earlier
    candidates that it can extend. A candidate keeps the place of the nearest
    earlier one with a lower sum before it, so those between the two are passed
    over once and never looked at again.
    """
    held: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first, last, nearest lower one
    total, at = 0.0, -1
    for p, s in zip(positions, scores):
        total += drift * (p - at - 1)
        at = p
        before, total = total, total + s
        if s <= 0:
            continue
        low, first, k = before, p, len(held) - 1
        while k >= 0 and held[k][0] >= low:
            k = held[k][4]
        while k >= 0 and held[k][1] < total:
            low, _, first, _, lower = held[k]
            del held[k:]
            k = lower
        held.append((low, total, first, p, k))
    return [(a, b, after - before) for before, after, a, b, _ in held]


def _measured(text, model, known: WordScores):
    """Number of tokens, the segments of a text, and its words.

    Every use of a word counts in full, wherever it stands and however often.
    """
    words = common.plain_words(text)
    hits = [(i, s) for i, s in enumerate(map(known.__getitem__, words)) if s is not None]
    return len(words), segments([i for i, _ in hits], [s for _, s in hits], model["drift"]), words


def _surprise(n: int, best: float, model) -> float:
    """-ln of the chance that a clean text of ``n`` tokens has so high a segment."""
    if best <= 0:
        return 0.0
    expected = model["k"] * max(n, 1) * math.exp(-model["lambda"] * best)
    return -math.log(max(-math.expm1(-expected), 1e-300))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, allowed, max_rows: int = MAX_TRAIN) -> DataFrame:
    """``text, label`` of about ``max_rows`` labelled documents, drawn by a hash of the id.

    Rows where ``allowed`` is false or the label is null are left out; a
    document with several label rows has the highest. Equal texts count once.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )
    n = marked.count()
    if n > max_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    chosen = F.broadcast(marked) if n <= common.MAX_BROADCAST_ROWS or max_rows <= common.MAX_BROADCAST_ROWS else marked
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label")


def held_out_part(parts: int, rest: int):
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts) == rest


def _logistic(x: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the most likely logistic curve, by Newton steps that must gain."""
    y = positive.astype(float)
    at = np.array([math.log(max(y.sum(), 1) / max((1 - y).sum(), 1)), 0.0])

    def loss(v):
        z = v[0] + v[1] * x
        return float((np.logaddexp(0, z) - y * z).sum() + 0.005 * v[1] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(at[0] + at[1] * x)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 0.01 * at[1]])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 0.01]])
        step, now = np.linalg.solve(h, g), loss(at)
        while loss(at + step) > now and abs(step).max() > 1e-9:
            step = step / 2
        at = at + step
        if abs(step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


def fit(sample: DataFrame) -> dict | None:
    """Model from ``text, label``: word scores, drift, and the calibration.

    None without both classes or without any telling word.

    In how many documents of each class a word stands is summed up in Spark (a
    word that one document repeats says little); only words whose log-odds lie ``MIN_Z`` standard errors from zero reach the driver, a number
    bounded by the bounded sample.
    """
    sample = common.cut(sample.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("label").alias("label")))

    def counted(batches):
        for batch in batches:
            sums: dict[bytes, list[int]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                for w in with_stems(common.plain_words(text)):
                    sums.setdefault(w, [0, 0])[label == 1] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([*sums], pa.binary()), pa.array([c[0] for c in sums.values()], pa.int64()),
                 pa.array([c[1] for c in sums.values()], pa.int64())], ["word", "clean", "toxic"],
            )

    counts = common.cut(
        sample.mapInArrow(counted, "word binary, clean long, toxic long")
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    n_clean, n_toxic = counts.agg(F.sum("clean"), F.sum("toxic")).first()
    if not n_clean or not n_toxic:
        return None
    share = F.lit(FLAT_PRIOR) + F.lit(PRIOR_SHARE) * (F.col("clean") + F.col("toxic"))
    strength = PRIOR_SHARE * (n_clean + n_toxic)

    def odds(y, n):
        return F.log((y + share) / (F.lit(n + strength) - y - share))

    delta = odds(F.col("toxic"), n_toxic) - odds(F.col("clean"), n_clean)
    part = F.lit(n_toxic / (n_clean + n_toxic)) * (F.col("clean") + F.col("toxic"))

    def excess(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (excess(F.col("toxic"), part) + excess(F.col("clean"), F.col("clean") + F.col("toxic") - part))
    z = F.signum(F.col("toxic") - part) * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    telling = (
        counts.withColumn("delta", delta).withColumn("z", z)
        .where((F.abs("z") >= MIN_Z) & ((F.col("z") < 0) | (F.col("toxic") >= MIN_TOXIC)))
        .select("word", "clean", "toxic", "delta").collect()
    )
    if not telling:
        return None
    rest_clean = n_clean - sum(r["clean"] for r in telling)
    rest_toxic = n_toxic - sum(r["toxic"] for r in telling)
    drift = min(math.log(max(rest_toxic, 0.5) / n_toxic) - math.log(max(rest_clean, 0.5) / n_clean), -1e-4)
    model = {"scores": {bytes(r["word"]): r["delta"] for r in telling}, "drift": drift, "k": 1.0, "a": 0.0, "b": 1.0}
    # lambda: under clean text the scores' moment generating function is one
    shares = np.array([r["clean"] + 0.5 for r in telling] + [rest_clean + 0.5]) / n_clean
    values = np.array([r["delta"] for r in telling] + [drift])
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(shares @ np.exp(np.minimum(mid * values, 700.0))) < shares.sum() else (low, mid)
    model["lambda"] = low

    def measured(batches):
        known = WordScores(model["scores"])
        for batch in batches:
            n, best = [], []
            for text in batch.column("text").to_pylist():
                size, found, _ = _measured(text, model, known)
                n.append(size)
                best.append(max((s for *_, s in found), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(n, pa.int64()), pa.array(best, pa.float64())], ["label", "n", "best"])

    seen = np.array(sample.mapInArrow(measured, "label int, n long, best double").collect(), dtype=float)  # three numbers a row
    label, n, best = seen.T
    clean = label != 1
    model["k"] = float(clean.sum() / max((np.maximum(n, 1) * np.exp(-model["lambda"] * best))[clean].sum(), 1e-9))
    x = np.array([_surprise(int(i), b, model) for i, b in zip(n, best)])
    x = np.minimum(x, MAX_SURPRISE)
    a, b = _logistic(x, ~clean)
    model["a"], model["b"] = float(a), max(float(b), 0.0)
    return model


def scored(docs: DataFrame, model: dict | None, names: tuple[str, str] = ("score", "passages")) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``passages``, or under other ``names``.

    ``passages`` lists every significant segment as ``(first, last, score, text)``
    in tokens. A null or empty text has no segment and the lowest score. Without
    a model (no labels of both kinds) every score is 0. Columns that have these
    names already are replaced.
    """
    docs = docs.drop(*names)
    if model is None:
        return docs.withColumn(names[0], F.lit(0.0)).withColumn(
            names[1], F.array().cast("array<struct<first:int,last:int,score:double,text:string>>")
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))

    def run(batches):
        m = shared.value
        known = WordScores(m["scores"])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            scores, passages = [], []
            for text in table.column("text").to_pylist():
                n, found, words = _measured(text, m, known)
                best = max((s for *_, s in found), default=0.0)
                scores.append(1 / (1 + math.exp(-(m["a"] + m["b"] * min(_surprise(n, best, m), MAX_SURPRISE)))))
                passages.append([
                    (a, b, s, b" ".join(words[a : b + 1]).decode("utf-8", "replace"))
                    for a, b, s in found if _surprise(n, s, m) >= -math.log(PASSAGE_P)
                ])
            rows = table.append_column(names[0], pa.array(scores, pa.float64())).append_column(names[1], pa.array(passages, kind))
            yield from rows.to_batches()

    passage = T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()).add("score", T.DoubleType()).add("text", T.StringType())
    schema = T.StructType(list(docs.schema.fields)).add(names[0], T.DoubleType()).add(names[1], T.ArrayType(passage))
    return docs.mapInArrow(run, schema)


def model_for(docs: DataFrame, labels: DataFrame) -> dict | None:
    return fit(training_rows(docs, labels, "toxic", ~held_out_part(5, 0)))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(held_out_part(5, 0), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

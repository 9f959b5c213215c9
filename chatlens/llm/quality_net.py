"""Text quality by a convolutional network over bytes, in numpy.

Learned filters run over every byte of a document, in overlapping chunks. Each
chunk keeps the highest answer of each filter (max-pooling); mean and maximum
over the chunks are weighed into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.toxicity import training_rows

FILTERS = 16
#: Bytes that a filter sees (even: a document is scored two bytes at a time).
WIDTH = 6
CHUNK, STRIDE = 512, 448
#: Labelled documents to fit on, about, and chunks taken from each, spread over the document.
MAX_TRAIN = 3_000
TRAIN_CHUNKS = 12
EPOCHS = 14
BATCH = 48
RATE = 0.01
THRESHOLD = 0.7
#: Bytes scored at once; maxima over chunks do not depend on it.
PIECE = 1024 * STRIDE


def encoded(text: str | None) -> np.ndarray:
    """The bytes of a text, with zeros up to one chunk for a short one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return data if len(data) >= CHUNK else np.r_[data, np.zeros(CHUNK - len(data), np.uint8)]


def chunk_starts(n: int) -> np.ndarray:
    """Starts of chunks that overlap and together cover ``n`` bytes; the last one ends at the end."""
    starts = np.arange(0, max(n - CHUNK, 0) + 1, STRIDE)
    return starts if starts[-1] + CHUNK >= n else np.r_[starts, n - CHUNK]


def train(docs: list[np.ndarray], label: np.ndarray, seed: int = 11) -> dict | None:
    """Fit filters and weights; ``docs`` holds an array (chunks, CHUNK) for each document."""
    if not len(docs):
        return None
    rng = np.random.default_rng(seed)
    prior = (label.sum() + 1.0) / (len(label) + 2.0)
    params = {
        "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weights": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "level": np.array([np.log(prior / (1 - prior))], np.float32),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            chunks = np.concatenate([docs[k] for k in part])
            of = np.repeat(np.arange(len(part)), [len(docs[k]) for k in part])
            n = CHUNK - WIDTH + 1
            answer = params["filters"][0][chunks[:, :n]]
            for j in range(1, WIDTH):
                answer += params["filters"][j][chunks[:, j : j + n]]
            at = answer.argmax(axis=1)
            pooled = np.take_along_axis(answer, at[:, None], axis=1)[:, 0] + params["bias"]
            active = pooled > 0
            pooled = np.where(active, pooled, 0)
            count = np.bincount(of, minlength=len(part))[:, None]
            edges = np.r_[0, np.cumsum(count[:, 0])[:-1]]
            mean = np.add.reduceat(pooled, edges) / count
            top = np.maximum.reduceat(pooled, edges)
            features = np.concatenate([mean, top], axis=1)
            p = 1 / (1 + np.exp(-np.clip(features @ params["weights"] + params["level"], -30, 30)))
            miss = ((p - label[part]) / len(part)).astype(np.float32)
            back = miss[:, None] * params["weights"]
            is_top = pooled == top[of]
            shared = np.add.reduceat(is_top.astype(np.float32), edges)
            down = (back[:, :FILTERS] / count)[of] + np.where(is_top, (back[:, FILTERS:] / shared)[of], 0)
            down = np.where(active, down, 0)
            grads = {
                "weights": features.T @ miss + 1e-4 * params["weights"], "level": np.array([miss.sum()]),
                "bias": down.sum(axis=0), "filters": np.zeros_like(params["filters"]),
            }
            rows, cols = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
            for j in range(WIDTH):
                flat = chunks[rows, at + j].astype(np.int64) * FILTERS + cols
                grads["filters"][j] = np.bincount(flat.ravel(), down.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads["filters"] += 1e-6 * params["filters"]
            step += 1
            for k, g in grads.items():
                one, two = moments[k]
                one += 0.1 * (g - one)
                two += 0.001 * (g * g - two)
                params[k] -= (RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return params


def pair_tables(params: dict) -> list[np.ndarray]:
    """Answers of all filters to each pair of bytes, for each pair of places in the filter."""
    w = params["filters"]
    return [np.ascontiguousarray((w[j][:, None, :] + w[j + 1][None, :, :]).reshape(1 << 16, FILTERS)) for j in range(0, WIDTH, 2)]


def probability(text: str | None, params: dict, tables: list[np.ndarray]) -> float:
    """Probability of good quality of a whole text; an empty one is a chunk of zeros."""
    data = encoded(text)
    total, top, count = np.zeros(FILTERS), np.zeros(FILTERS, np.float32), 0
    starts = chunk_starts(len(data))
    span = CHUNK - WIDTH + 1
    per_piece = PIECE // STRIDE
    for i in range(0, len(starts), per_piece):
        part = starts[i : i + per_piece]
        piece = data[part[0] : part[-1] + CHUNK].astype(np.uint16)
        pair = (piece[:-1] << 8) | piece[1:]
        n = len(piece) - WIDTH + 1
        answer = tables[0][pair[:n]]
        for j, rows in enumerate(tables[1:], 1):
            answer += rows[pair[2 * j : 2 * j + n]]
        edges = np.stack([part - part[0], part - part[0] + span], axis=1).ravel()
        if edges[-1] >= n:
            edges = edges[:-1]
        pooled = np.maximum.reduceat(answer, edges)[::2] + params["bias"]
        pooled = np.maximum(pooled, 0)
        total += pooled.sum(axis=0)
        top = np.maximum(top, pooled.max(axis=0))
        count += len(part)
    z = float(np.concatenate([total / count, top]) @ params["weights"] + params["level"][0])
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, allowed) -> dict | None:
    """Model from a bounded sample of labelled rows; None without any."""

    def run(batches):
        for batch in batches:
            chunks, label = [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                data = encoded(text)
                starts = chunk_starts(len(data))
                if len(starts) > TRAIN_CHUNKS:
                    starts = starts[np.linspace(0, len(starts) - 1, TRAIN_CHUNKS).astype(int)]
                chunks.append(b"".join(data[s : s + CHUNK].tobytes() for s in starts))
                label.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), pa.array(label, pa.int32())], ["chunks", "label"])

    sample = training_rows(docs, labels, "quality", allowed, MAX_TRAIN).mapInArrow(run, "chunks binary, label int")
    rows = sample.orderBy(F.xxhash64("chunks"), "label").collect()  # MAX_TRAIN x TRAIN_CHUNKS x CHUNK bytes
    arrays = [np.frombuffer(bytes(r["chunks"]), np.uint8).reshape(-1, CHUNK) for r in rows]
    return train(arrays, np.array([r["label"] for r in rows], np.float32))


def scored(docs: DataFrame, params: dict | None) -> DataFrame:
    """``doc_id, score`` of every document; without a model every score is 0.

    A null text counts as an empty one. Repeated rows get equal scores.
    """
    if params is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(params)  # a fixed number of weights

    def run(batches):
        tables = pair_tables(shared.value)
        for batch in batches:
            scores = [probability(t, shared.value, tables) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    params = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), part != 2)
    return scored(docs, params).select(
        "doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )

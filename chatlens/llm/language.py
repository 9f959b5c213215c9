"""Language of words in code-switched text by a linear-chain conditional random field.

Every word of a text gets a language. A word's own evidence comes from affixes
(first and last three bytes), n-grams (two and three bytes, word edges included)
and a lexicon of words seen in training; learned transitions join neighbours.
Training and prediction use forward-backward over all words of many texts at
once, in two levels of blocks, so the work is done by array operations.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatlens.llm import common

#: Documents of each language to fit on, segments taken from each, words of a segment.
TRAIN_DOCS = 600
TRAIN_SEGMENTS = 4
SEGMENT_WORDS = 20
#: Segments of different documents that are joined to one training sequence.
SWITCHES = 6
STEPS = 40
RATE = 0.15
RIDGE = 1e-5
#: Documents of the sample that a word must stand in to enter the lexicon.
LEXICON_DOCS = 5
TABLE = 1 << 16
#: Bytes of text that are worked on at once. The chain of a longer text starts anew after each piece.
PIECE = 1 << 20
UNKNOWN = "und"

_FOLD = bytes(c if c >= 0x80 or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of a letter category; digits of any kind, as ``²`` or ``Ⅷ``, are none."""
    return bool(text) and any(map(str.isalpha, text))


def folded(text: str) -> bytes:
    """Lower case, with all ASCII but letters made blank; edges are blank."""
    return b"  " + text.lower().encode("utf-8", "surrogatepass").translate(_FOLD) + b"  "


class Words:
    """Features of all words of some texts, as array indices."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        letter = np.r_[False, data != 0x20, False]
        turn = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = turn[::2], turn[1::2]
        self.n = len(self.start)
        ends = np.cumsum([len(t) for t in texts])
        self.doc = np.searchsorted(ends, self.start, "right")
        self.first = np.r_[True, self.doc[1:] != self.doc[:-1]] if self.n else np.zeros(0, bool)
        wide = data.astype(np.uint32)
        self.two = (wide[:-1] << 8) | wide[1:]
        three = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
        self.three = ((three * np.uint32(2654435761)) >> 16).astype(np.uint32)
        self.prefix, self.suffix = self.three[self.start], self.three[np.maximum(self.end - 3, 0)]
        # n-grams that touch the word: from the blank before it to its last byte
        self.lo, self.hi = self.start - 1, self.end
        powers = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, np.uint64)])
        back = np.cumprod(np.r_[np.uint64(1), np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)]
        code = (sums[self.end] - sums[self.start]) * back[self.start] * _MIX
        self.code = code ^ (code >> np.uint64(31))

    def emissions(self, model) -> np.ndarray:
        known = np.minimum(np.searchsorted(model["lexicon"], self.code), max(len(model["lexicon"]) - 1, 0))
        out = model["prefix"][self.prefix] + model["suffix"][self.suffix] + model["bias"]
        if len(model["lexicon"]):
            out += np.where((model["lexicon"][known] == self.code)[:, None], model["word"][known], 0)
        for name, index, hi in (("two", self.two, self.hi), ("three", self.three, self.hi - 1)):
            sums = np.zeros((len(index) + 1, out.shape[1]))
            np.cumsum(model[name][index], axis=0, out=sums[1:])
            out += sums[hi] - sums[self.lo]
        return out


def forward_backward(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Posteriors ``(n, L)``, expected transition counts ``(L, L)`` and the log-likelihood's normaliser.

    The sequence is cut into blocks. Products of step matrices over all blocks
    advance together, then one short pass over blocks gives each its way in and
    out, then vectors advance over all blocks together. A first word forgets
    what came before it.
    """
    n, size = emission.shape
    steps = max(1, int(np.sqrt(n)))
    blocks = -(-n // steps)
    top = emission.max(axis=1, keepdims=True)
    e = np.ones((blocks * steps, size))
    e[:n] = np.exp(emission - top)
    fresh = np.zeros(blocks * steps, bool)
    fresh[:n] = first
    fresh[n:] = True
    e, fresh = e.reshape(blocks, steps, size), fresh.reshape(blocks, steps)
    a, s = np.exp(transition), np.exp(start - start.max())
    s = s / s.sum()
    reset = np.tile(s, (size, 1))
    whole = np.tile(np.eye(size), (blocks, 1, 1))
    for t in range(steps):
        m = np.where(fresh[:, t, None, None], reset, a) * e[:, t, None, :]
        whole = whole @ m
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    into, back = np.empty((blocks, size)), np.empty((blocks, size))
    v = np.full(size, 1.0 / size)
    for b in range(blocks):
        into[b] = v
        v = v @ whole[b]
        v /= v.sum()
    v = np.ones(size)
    for b in range(blocks - 1, -1, -1):
        back[b] = v
        v = whole[b] @ v
        v /= v.sum()
    ahead = np.empty((blocks, steps, size))
    norm = np.empty((blocks, steps))
    v = into
    for t in range(steps):
        v = np.where(fresh[:, t, None], s * v.sum(axis=1, keepdims=True), v @ a) * e[:, t]
        norm[:, t] = v.sum(axis=1)
        v = v / norm[:, t, None]
        ahead[:, t] = v
    behind = np.empty((blocks, steps, size))
    v = back
    for t in range(steps - 1, -1, -1):
        behind[:, t] = v
        w = v * e[:, t]
        v = np.where(fresh[:, t, None], (w @ s)[:, None], w @ a.T)
        v = v / v.sum(axis=1, keepdims=True)
    ahead, behind = ahead.reshape(-1, size)[:n], behind.reshape(-1, size)[:n]
    post = ahead * behind + 1e-300
    post /= post.sum(axis=1, keepdims=True)
    right = (e.reshape(-1, size)[:n] * behind)[1:][~first[1:]]
    left = ahead[:-1][~first[1:]]
    scale = np.einsum("ni,ij,nj->n", left, a, right)
    pairs = a * (left.T @ (right / scale[:, None]))
    log_norm = float(np.log(norm.reshape(-1)[:n]).sum() + top.sum())
    return post, pairs, log_norm


def train(texts: list[str], langs: list[str]) -> dict | None:
    """Fit on segments of texts in one language each, stitched to sequences that switch."""
    names = sorted(set(langs))
    if not names:
        return None
    size = len(names)
    place = {name: i for i, name in enumerate(names)}
    order = np.random.default_rng(7).permutation(len(texts))
    joined, tags = [], []
    for i in range(0, len(order), SWITCHES):
        part = order[i : i + SWITCHES]
        joined.append(b"".join(folded(texts[k]) for k in part))
        for k in part:
            tags.append(np.full(Words([folded(texts[k])]).n, place[langs[k]]))
    words = Words(joined)
    tag = np.concatenate(tags) if tags else np.zeros(0, int)
    if not words.n:
        return None
    seen, inverse, times = np.unique(words.code, return_inverse=True, return_counts=True)
    lexicon = seen[times >= LEXICON_DOCS]
    model = {
        "names": names, "lexicon": lexicon, "word": np.zeros((max(len(lexicon), 1), size)),
        "two": np.zeros((TABLE, size)), "three": np.zeros((TABLE, size)),
        "prefix": np.zeros((TABLE, size)), "suffix": np.zeros((TABLE, size)),
        "bias": np.zeros(size), "transition": np.zeros((size, size)), "start": np.zeros(size),
    }
    truth = np.eye(size)[tag]
    stays = ~words.first[1:]
    pairs_seen = np.zeros((size, size))
    np.add.at(pairs_seen, (tag[:-1][stays], tag[1:][stays]), 1)
    of_two = np.repeat(np.arange(words.n), words.hi - words.lo)
    at_two = np.concatenate([np.arange(a, b) for a, b in zip(words.lo, words.hi)])
    inner = at_two < np.repeat(words.hi - 1, words.hi - words.lo)
    known = np.minimum(np.searchsorted(lexicon, words.code), max(len(lexicon) - 1, 0))
    in_lexicon = (lexicon[known] == words.code) if len(lexicon) else np.zeros(words.n, bool)
    uses = {
        "two": (words.two[at_two], of_two), "three": (words.three[at_two[inner]], of_two[inner]),
        "prefix": (words.prefix, np.arange(words.n)), "suffix": (words.suffix, np.arange(words.n)),
        "word": (known[in_lexicon], np.flatnonzero(in_lexicon)),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items() if k not in ("names", "lexicon")}
    for step in range(1, STEPS + 1):
        post, pairs, _ = forward_backward(words.emissions(model), words.first, model["transition"], model["start"])
        miss = (truth - post) / words.n
        grads = {
            name: np.stack([np.bincount(index, miss[of, k], len(model[name])) for k in range(size)], axis=1)
            for name, (index, of) in uses.items()
        }
        grads["bias"] = miss.sum(axis=0)
        grads["start"] = miss[words.first].sum(axis=0)
        grads["transition"] = (pairs_seen - pairs) / words.n
        for name, g in grads.items():
            g = g - RIDGE * model[name]
            one, two = moments[name]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            model[name] += RATE * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype(np.float32) if k in ("two", "three", "prefix", "suffix", "word") else v for k, v in model.items()}


def training_segments(docs: DataFrame, allowed) -> DataFrame:
    """``text, lang`` of bounded size: spread segments of up to ``TRAIN_DOCS`` documents of each language."""
    draw = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("lang")), "doc_id")
    chosen = (
        docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & allowed).select("doc_id", "lang")
        .withColumn("_k", F.row_number().over(draw)).where(F.col("_k") <= TRAIN_DOCS).select("doc_id").distinct()
    )

    def run(batches):
        for batch in batches:
            texts, langs = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words = text.split()
                gap = max(SEGMENT_WORDS, len(words) // TRAIN_SEGMENTS)
                for i in range(0, len(words), gap):
                    texts.append(" ".join(words[i : i + SEGMENT_WORDS]))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.string())], ["text", "lang"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return rows.join(common.small_or_whole(chosen), "doc_id").select("text", "lang").mapInArrow(run, "text string, lang string")


def predict(texts: list[str | None], model: dict | None) -> list[tuple[str, float, list[float] | None]]:
    """Language, score and share of words by language of each text."""
    out: list = [(UNKNOWN, 0.0, None)] * len(texts)
    if model is None:
        return out
    totals: dict[int, np.ndarray] = {}
    for piece in _pieces(texts):
        words = Words([t for _, t in piece])
        if words.n:
            post, _, _ = forward_backward(words.emissions(model), words.first, model["transition"], model["start"])
            for k, (i, _) in enumerate(piece):
                totals[i] = totals.get(i, 0) + post[slice(*np.searchsorted(words.doc, [k, k + 1]))].sum(axis=0)
    for i, total in totals.items():
        if total.sum() > 0:
            share = total / total.sum()
            best = int(share.argmax())
            out[i] = (model["names"][best], float(min(share[best], 1.0)), share.tolist())
    return out


def _pieces(texts: list[str | None]):
    """Lists of ``(number of the text, folded bytes)`` of about ``PIECE`` bytes, cut at blanks."""
    piece, held = [], 0
    for i, text in enumerate(texts):
        data = folded(text) if has_letter(text) else b""
        at = 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            part = b"  " + data[at:end] + b"  "
            if held and held + len(part) > PIECE:
                yield piece
                piece, held = [], 0
            piece.append((i, part))
            held += len(part)
            at = end
    if piece:
        yield piece


def predicted(docs: DataFrame, model: dict | None) -> DataFrame:
    """``doc_id, lang_pred, score``. Null texts and texts without a letter are ``und`` with score 0.

    Without any labelled text all are ``und``. Repeated rows get equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by tables of fixed size and the sample's lexicon

    def run(batches):
        for batch in batches:
            found = predict(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def fit(docs: DataFrame, allowed) -> dict | None:
    rows = training_segments(docs, allowed).orderBy(F.xxhash64("text"), "lang").collect()  # bounded sample
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return predicted(docs, fit(docs, part != 1)).select(
        "doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )

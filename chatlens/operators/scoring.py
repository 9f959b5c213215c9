"""Hook for a sentiment model that runs inside the Spark job."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.functions.text import strip

SCORE_TYPE = "struct<positive:double,negative:double,neutral:double,failed:boolean>"
SCORES = ["positive", "negative", "neutral"]
Model = Callable[[pd.Series], pd.DataFrame]
#: Tokens that a model of 512 takes besides its two marks, and those that windows share.
WINDOW, OVERLAP = 510, 50


def cut_windows(text: str, spans: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[str, int]]:
    """``text`` in windows of at most ``size`` tokens, with the number of tokens that each brings anew.

    ``spans`` are the places of its tokens. A window begins ``overlap`` tokens
    before the one before it ends; a text without tokens is one window.
    """
    if len(spans) <= size:
        return [(text, max(len(spans), 1))]
    out = []
    for i in range(0, len(spans) - overlap, size - overlap):
        last = min(i + size, len(spans))
        out.append((text[spans[i][0]:spans[last - 1][1]], last - i - (overlap if i else 0)))
    return out


def _scored(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of texts; not a number for those that the model fails on, even alone.

    What fails is halved until it passes or is a single text. Like texts stand
    together then, as they mostly fail alike; the scores come in the order given.
    """
    def score(part: list[str]) -> np.ndarray:
        found = model(pd.Series(part))
        return np.column_stack([found[c].to_numpy("float64") for c in SCORES])

    try:
        return score(texts)
    except Exception:  # any fault of a foreign model costs its own texts only
        pass
    out = np.full((len(texts), len(SCORES)), np.nan)
    order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
    halves = [order[:len(order) // 2], order[len(order) // 2:]] if len(order) > 1 else []
    while halves:
        places = halves.pop()
        try:
            out[places] = score([texts[i] for i in places])
        except Exception:
            if len(places) > 1:
                halves += [places[:len(places) // 2], places[len(places) // 2:]]
    return out


def _pooled(model: Model, windows: list[list[tuple[str, int]]], at_once: int) -> np.ndarray:
    """Mean score of the windows of each text by their tokens. Windows of like length go to the model together."""
    flat = sorted(((n, i, text) for i, found in enumerate(windows) for text, n in found), key=lambda w: (len(w[2]), w[1]))
    sums, weights = np.zeros((len(windows), len(SCORES))), np.zeros(len(windows))
    for at in range(0, len(flat), at_once):
        part = flat[at:at + at_once]
        for (n, i, _), row in zip(part, _scored(model, [w[2] for w in part])):
            if not np.isnan(row).any():
                sums[i] += n * row
                weights[i] += n
    with np.errstate(invalid="ignore"):
        return sums / weights[:, None]


def with_scores(
    df: DataFrame,
    load_model: Callable[[], Model],
    text: str = "text",
    max_chars: int | None = None,
    load_tokens: Callable[[], Callable[[str], list[tuple[int, int]]]] | None = None,
    window: int = WINDOW,
    overlap: int = OVERLAP,
    at_once: int | None = None,
) -> DataFrame:
    """Adds positive, negative, neutral for investment messages, null for others,
    and ``model_failed``.

    ``load_model`` runs once in each Python worker and returns a function from a
    series of texts to a frame with the three score columns; it travels to the
    executors by value. It gets whole texts; for a model that cannot shorten
    them itself ``max_chars`` does. For a model with a bounded number of tokens
    ``load_tokens`` gives its tokenizer, a function from a text to the places of
    its tokens: longer texts are cut into windows of ``window`` tokens that
    overlap, and their scores are pooled, so no part of a text goes unread.
    ``at_once`` windows go to the model together (None: all of an Arrow batch).
    Rows that are not about investment reach Python as nulls and the model not
    at all. A batch that the model fails on is tried again text by text; one that
    fails alone is passed over, and a message without any score is marked
    ``model_failed`` and gets the verdict neutral with confidence zero.
    """
    ours = f"model-{uuid.uuid4().hex}"

    @F.pandas_udf(SCORE_TYPE)
    def score(texts: pd.Series) -> pd.DataFrame:
        import sys

        kept = sys.modules.setdefault("_chatlens_models", {})
        if ours not in kept:
            kept[ours] = load_model(), load_tokens() if load_tokens else None
        model, tokens = kept[ours]
        out = pd.DataFrame(index=texts.index, columns=SCORES, dtype="float64").assign(failed=False)
        given = texts[texts.notna()]
        if len(given):
            parts = [cut_windows(t, tokens(t), window, overlap) if tokens else [(t, 1)] for t in given]
            found = _pooled(model, parts, at_once or sum(map(len, parts)))
            out.loc[given.index, SCORES] = found
            out.loc[given.index, "failed"] = np.isnan(found).any(axis=1)
        return out

    body = strip(F.col(text))
    given = body if max_chars is None else F.substring(body, 1, max_chars)
    wanted = F.col("is_investment") & (body != "")
    scored = df.withColumn("_scores", score(F.when(wanted, given)))
    return scored.select(
        *[F.col(c) for c in df.columns], *[F.col(f"_scores.{c}").alias(c) for c in SCORES],
        F.col("_scores.failed").alias("model_failed"),
    )

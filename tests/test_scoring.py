"""Windows of long texts before a model."""

import re

import numpy as np
import pandas as pd
import pytest

from chatlens.operators import scoring


def spans(text):
    return [m.span() for m in re.finditer(r"\S+", text)]


@pytest.mark.parametrize("n, size, overlap", [(0, 5, 2), (1, 5, 2), (5, 5, 2), (6, 5, 2), (8, 5, 2), (9, 5, 0), (1000, 510, 50), (2341, 510, 50)])
def test_windows_hold_every_token(n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    found = scoring.cut_windows("  ".join(words), spans("  ".join(words)), size, overlap)
    new = []
    for i, (text, brings) in enumerate(found):
        held = text.split()
        assert len(held) <= size and (i == 0 or len(held) - brings == overlap)
        new += held[len(held) - brings:] if held else []
    assert new == words


def test_scores_are_pooled_by_tokens_and_like_lengths_go_together():
    asked = []

    def model(texts):
        asked.append([len(t) for t in texts])
        if any("bad" in t for t in texts):
            raise ValueError
        n = texts.str.len().astype(float)
        return pd.DataFrame({"positive": n, "negative": 2 * n, "neutral": 0 * n})

    windows = [[("aaaa", 3), ("bb", 1)], [("c" * 9, 7)], [("bad", 2), ("dddd", 2)], [("bad", 1)]]
    got = scoring._pooled(model, windows, 2)
    assert got[:3, 0].tolist() == [(3 * 4 + 2) / 4, 9.0, 4.0] and np.isnan(got[3]).all()
    lengths = [x for part in asked for x in (part if len(part) > 1 else [])]
    assert lengths == sorted(lengths)


def test_what_fails_is_halved_and_scores_keep_their_order():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if texts.str.contains("bad").any():
            raise ValueError
        n = texts.str.len().astype(float)
        return pd.DataFrame({"positive": n, "negative": 2 * n, "neutral": 0 * n})

    texts = ["bad" if i % 10 == 3 else "x" * (1 + i % 7) for i in range(1000)]
    got = scoring._scored(model, texts)
    assert all(np.isnan(g).all() if t == "bad" else g.tolist() == [len(t), 2 * len(t), 0] for t, g in zip(texts, got))
    assert len(calls) < 2 * 100 + 30  # one by one: 1001
    calls.clear()
    assert np.isnan(scoring._scored(model, ["bad"])).all() and calls == [1]
    assert scoring._scored(model, ["a", "bad", "ab"])[[0, 2], 0].tolist() == [1, 2]

"""Models and per-text operators: held-out accuracy, brute force, odd input."""

import math
import time
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatlens.llm import html_template, language, quality_net, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out(rows, truth):
    return [(r, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]


# ---- language


def test_language_held_out(spark, tables):
    docs, _ = tables
    rows = language.op2(spark, SF).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    pairs = held_out(rows, {r.doc_id: r.lang for r in docs.collect()})
    assert len(pairs) > 200 and sum(r.lang_pred == t for r, t in pairs) / len(pairs) >= 0.98


def test_forward_backward():
    rng = np.random.default_rng(0)
    n, size = 37, 3
    e, t, s = rng.normal(size=(n, size)), rng.normal(size=(size, size)), rng.normal(size=size)
    first = rng.random(n) < 0.2
    first[0] = True
    begin = s - np.log(np.exp(s).sum())
    a, b = np.zeros((n, size)), np.zeros((n, size))
    for i in range(n):
        a[i] = e[i] + (begin + (np.log(np.exp(a[i - 1]).sum()) if i else 0) if first[i] else np.log(np.exp(a[i - 1][:, None] + t).sum(0)))
    for i in range(n - 2, -1, -1):
        step = begin if first[i + 1] else t
        b[i] = np.log(np.exp(step + e[i + 1] + b[i + 1]).sum(-1))
    want = np.exp(a + b)
    post, pairs, norm = language.forward_backward(e, first, t, s)
    assert np.allclose(post, want / want.sum(1, keepdims=True)) and math.isclose(norm, np.log(np.exp(a[-1]).sum()))
    assert math.isclose(pairs.sum(), (~first).sum())


def test_words_switch_language(tables):
    docs, _ = tables
    texts = {r.lang: r.text for r in docs.where("n_chars > 3000").orderBy("doc_id").limit(60).collect()}
    model = language.train([t for t in texts.values()] * 2, [*texts] * 2)
    mixed = [" ".join(texts[k].split()[:40]) for k in sorted(texts)[:2]]
    words = language.Words([language.folded(" ".join(mixed))])
    post, _, _ = language.forward_backward(words.emissions(model), words.first, model["transition"], model["start"])
    tags = post.argmax(1)
    half = language.Words([language.folded(mixed[0])]).n
    right = (tags[:half] == model["names"].index(sorted(texts)[0])).mean(), (tags[half:] == model["names"].index(sorted(texts)[1])).mean()
    assert min(right) > 0.9


def test_language_of_odd_rows(odd, none):
    model = language.fit(odd, F.lit(True))
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.predicted(odd, model).collect()}
    assert (3, "und", 0.0) in got and (4, "und", 0.0) in got and (8, "und", 0.0) in got
    assert all(lang in ("en", "fr", "de", "und") for _, lang, _ in got)
    assert language.fit(none, F.lit(True)) is None and language.predicted(none, None).count() == 0
    assert {r.lang_pred for r in language.predicted(odd, None).collect()} == {"und"}


def test_long_text_in_pieces(tables, monkeypatch):
    docs, _ = tables
    text = docs.where("lang = 'de'").orderBy(F.desc("n_chars")).first().text
    model = language.fit(docs, F.lit(True))
    whole = language.predict([text], model)[0]
    monkeypatch.setattr(language, "PIECE", 300)
    parts = language.predict([None, text, "x"], model)[1]
    assert whole[0] == parts[0] == "de" and abs(whole[1] - parts[1]) < 0.05


# ---- quality network


def test_quality_held_out(spark, tables):
    docs, labels = tables
    rows = quality_net.op5(spark, SF).collect()
    assert len(rows) == docs.count() and all(r.predicted == (r.score >= 0.7) for r in rows)
    pairs = held_out(rows, {r.doc_id: r.quality for r in labels.collect()})
    good = [r.predicted for r, t in pairs if t == 1]
    bad = [r.predicted for r, t in pairs if t == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.35


def test_network_against_plain_loops():
    rng = np.random.default_rng(1)
    params = {"filters": rng.normal(size=(quality_net.WIDTH, 256, quality_net.FILTERS)).astype(np.float32),
              "bias": rng.normal(size=quality_net.FILTERS).astype(np.float32),
              "weights": rng.normal(0, 0.05, 2 * quality_net.FILTERS).astype(np.float32), "level": np.zeros(1, np.float32)}
    tables = quality_net.pair_tables(params)
    for n in (0, 5, 512, 513, 960, 1500, 5000):
        text = "".join(chr(rng.integers(32, 300)) for _ in range(n))
        data = quality_net.encoded(text)
        starts = quality_net.chunk_starts(len(data))
        assert starts[0] == 0 and starts[-1] + quality_net.CHUNK == len(data)
        assert all(b - a < quality_net.CHUNK for a, b in zip(starts, starts[1:]))
        pooled = np.array([
            np.max([sum(params["filters"][j][data[s + p + j]] for j in range(quality_net.WIDTH)) for p in range(quality_net.CHUNK - quality_net.WIDTH + 1)], axis=0)
            for s in starts
        ]) + params["bias"]
        pooled = np.maximum(pooled, 0)
        z = np.concatenate([pooled.mean(0), pooled.max(0)]) @ params["weights"]
        assert math.isclose(quality_net.probability(text, params, tables), 1 / (1 + math.exp(-z)), abs_tol=1e-4)


def test_network_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    params = quality_net.train([rng.integers(0, 255, (2, 512)).astype(np.uint8) for _ in range(8)], np.array([0, 1] * 4, np.float32))
    tables, text = quality_net.pair_tables(params), "The quick brown fox. " * 700
    whole = quality_net.probability(text, params, tables)
    monkeypatch.setattr(quality_net, "PIECE", 3 * quality_net.STRIDE)
    assert math.isclose(whole, quality_net.probability(text, params, tables), abs_tol=1e-5)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (None, 1), (7, None), (1, 0)], "doc_id long, quality int")
    params = quality_net.fit(odd, labels, F.lit(True))
    assert quality_net.scored(odd, params).count() == odd.count()
    assert quality_net.fit(odd, labels.limit(0), F.lit(True)) is None
    assert [r.score for r in quality_net.scored(odd, None).collect()] == [0.0] * odd.count()
    assert quality_net.scored(none, params).count() == 0


# ---- toxicity


def test_toxicity_held_out(spark, tables):
    docs, labels = tables
    rows = toxicity.op8(spark, SF).collect()
    assert len(rows) == docs.count()
    pairs = held_out(rows, {r.doc_id: r.toxic for r in labels.collect()})
    found = [r.predicted for r, t in pairs if t == 1]
    alarms = [r.predicted for r, t in pairs if t == 0]
    assert sum(found) / len(found) >= 0.6 and sum(alarms) / len(alarms) <= 0.02


def best_segment(line):
    return max([0.0] + [sum(line[i : j + 1]) for i in range(len(line)) for j in range(i, len(line))])


def all_maximal(line):
    """Maximal scoring segments by their definition: take the best, go on left and right of it."""
    best, at = 0.0, None
    for i in range(len(line)):
        for j in range(i, len(line)):
            s = sum(line[i : j + 1])
            if s > best + 1e-12 or at and abs(s - best) <= 1e-12 and j - i < at[1] - at[0]:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    return [(a, b) for a, b in all_maximal(line[:i])] + [(i, j)] + [(a + j + 1, b + j + 1) for a, b in all_maximal(line[j + 1 :])]


def test_segments_are_the_maximal_ones():
    rng = random.Random(5)
    for _ in range(200):
        line = [round(rng.uniform(-3, 3), 3) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(list(range(len(line))), line, -0.5)
        assert [(a, b) for a, b, _ in got] == all_maximal(line)
        assert math.isclose(max([s for *_, s in got] + [0.0]), best_segment(line), abs_tol=1e-9)


def test_segments_between_silent_tokens():
    line = [-0.5] * 30
    line[3], line[5], line[20], line[29] = 2.0, 1.0, 4.0, 0.25
    at = [3, 5, 20, 29]
    assert [(a, b) for a, b, _ in toxicity.segments(at, [line[i] for i in at], -0.5)] == all_maximal(line)


def test_passages_and_odd_rows(spark, odd, none):
    docs = spark.createDataFrame(
        [(i, ("nice day and more " * 5) + ("vile scum " if i % 2 else "good folk ") + f"end{i}") for i in range(60)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels, "toxic", F.lit(True)))
    rows = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    assert all((r.score >= 0.5) == bool(i % 2) for i, r in rows.items())
    assert all("scum" in p.text for i, r in rows.items() if i % 2 for p in r.passages) and rows[1].passages
    out = toxicity.scored(odd, model)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert {r.score < 0.5 for r in out.collect()} == {True}
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.fit(toxicity.training_rows(docs, labels.limit(0), "toxic", F.lit(True))) is None
    assert {r.score for r in toxicity.scored(odd, None).collect()} == {0.0}


# ---- quality rules


def plain_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def test_base_counts(spark, documents, odd):
    for docs in (documents, odd):
        texts = Counter((r.doc_id, *plain_base(r.text)) for r in docs.collect())
        got = quality_rules.judged(docs, quality_rules.references(docs)).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
        assert not any(r.base_failed and r.kept for r in got)


def test_rules_keep_good_documents(spark, tables):
    docs, labels = tables
    rows = {r.doc_id: r for r in quality_rules.op10(spark, SF).collect()}
    good = [rows[r.doc_id] for r in labels.collect() if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id] for r in labels.collect() if r.quality == 0 and not rows[r.doc_id].base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(r.kept for r in bad) / len(bad) < 0.5


def test_distance():
    p, q = np.array([1.0, 3, 0]), np.array([0.0, 0, 5])
    assert quality_rules.distance(p, p) == 0 and math.isclose(quality_rules.distance(p, q), 1)
    assert quality_rules.distance(p, np.zeros(3)) == 0


def test_classes_tell_scripts_apart():
    q = quality_rules
    kinds = lambda text: q.classes(text, text.encode("utf-8", "surrogatepass"))
    named = lambda text: {q.CLASSES[i]: int(n) for i, n in enumerate(kinds(text)) if n}
    assert named("aB3 .$\x01") == dict.fromkeys(("lower", "upper", "digit", "space", "stop", "symbol", "control"), 1)
    assert named("éÉßαΩжя漢字かなカナ한글אبहไ") == {
        "LATIN": 3, "GREEK": 2, "CYRILLIC": 2, "CJK": 2, "HIRAGANA": 2, "KATAKANA": 2, "HANGUL": 2, "HEBREW": 1,
        "ARABIC": 1, "DEVANAGARI": 1, "THAI": 1,
    }
    assert named("½“…€\u00a0\u200b\ud800\U0001f600ᚠ") == {"N": 1, "P": 2, "S": 2, "Z": 1, "C": 2, "other script": 1}
    greek, cyrillic = kinds("αβγ δεζ"), kinds("абв где")
    assert q.distance(greek, cyrillic) > 0.9 and q.distance(greek, kinds("ηθι κλμ")) == 0
    assert all(kinds(text).sum() == len(text) for text in ("", "é" * 9, "\U0010ffff"))


def test_verdicts_equal_a_plain_reading(spark, tables):
    """References, both distances and the verdict of every document, one character and one word at a time."""
    docs = tables[0]
    rows = docs.collect()
    q = quality_rules
    chars, words = {}, {}
    split = lambda text: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    kind = lambda c: q._class_of(ord(c)) if c < "\x80" else q._class_beyond(ord(c))
    own = [(Counter(map(kind, r.text or "")), Counter(split(r.text or ""))) for r in rows]
    for r, (c, w) in zip(rows, own):
        for lang in {r.lang, q.ALL} - {None}:
            chars.setdefault(lang, Counter()).update(c)
            words.setdefault(lang, Counter()).update(w)
    common = {k: [w for w, _ in sorted(v.items(), key=lambda x: (-x[1], x[0].encode()))[:q.TOP_WORDS]] for k, v in words.items()}

    def apart(a, b):
        n, m = sum(a.values()), sum(b.values())
        out = 0.0
        for k in {*a, *b}:
            x, y = a.get(k, 0) / n, b.get(k, 0) / m
            out += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
        return max(0.0, out) ** 0.5

    def folded(counts, lang):
        held = {w: counts[w] for w in common[lang]}
        return {**held, None: sum(counts.values()) - sum(held.values())}

    got = {r.doc_id: r for r in q.op10(spark, SF).collect()}
    assert len(got) == len(rows)
    for r, (c, w) in zip(rows, own):
        row, lang = got[r.doc_id], q.ALL if r.lang is None else r.lang
        by_class = apart(c, chars[lang]) if row.word_chars >= q.MIN_CHARS else None
        by_word = apart(folded(w, lang), folded(words[lang], lang)) if row.n_words >= q.MIN_COMMON else None
        for value, want in ((row.class_distance, by_class), (row.word_distance, by_word)):
            assert value == want if want is None else math.isclose(value, want, abs_tol=1e-6)
        bad = (by_class or 0) > q.MAX_CLASS_DISTANCE or (by_word or 0) > q.MAX_WORD_DISTANCE + q.WORD_NOISE / max(row.n_words, 1) ** 0.5
        assert row.kept == (not row.base_failed and not bad)


def test_references_count_everything(spark, documents):
    refs = quality_rules.references(documents)
    text = "".join(r.text or "" for r in documents.where("lang = 'fr'").collect())
    assert refs["fr"][0].sum() == len(text) and refs["*"][0].sum() > refs["fr"][0].sum()
    assert quality_rules.references(documents.limit(0)) == {}


# ---- pages

FRAME = (
    "<html><head><title>T {i}</title><script>if (a < b) {{ x('</p>') }}</script></head><body><div class=x1>Welcome to the shop</div>"
    "<nav><ul><li><a href=/{i}>Link {i}</a></ul></nav><div class='side-bar'><p>side {i}</div>"
    "<div id=c><h1>Head &amp; line {i}</h1><p>First <b>para</b>graph\n of {i}.<p>Second&nbsp;one {i}<div class=notice>Cookies {i}</div></div>"
    "<p class=y>Call us any time</p><section class='comments'><article><p>I disagree {i}</p></article></section>"
    "<footer>&copy; {i}</footer></body></html>"
)


def test_pages_of_one_host(spark):
    rows = [(i, f"http://A.example/{i}", FRAME.format(i=i)) for i in range(12)] + [(50, "http://b.example/", FRAME.format(i=50)), (51, None, FRAME.format(i=51))]
    out = {r.page_id: r for r in html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = "Head & line {i}\nFirst paragraph of {i}.\nSecond one {i}"
    for i in range(12):
        assert out[i].text == own.format(i=i) and out[i].n_chars == len(out[i].text)
    alone = "Welcome to the shop\n" + own + "\nCall us any time"  # no other page tells what is constant there
    assert out[50].text == alone.format(i=50) and out[51].text == alone.format(i=51)


def test_article_wins_and_broken_markup():
    page = html_template.Page
    assert page("<p>out</p><article><h1>A</h1><p>in <i>x<br>y</article><p>out").text() == "A\nin x\ny"
    assert page("a < b &lt; c &#233; &eacute <!-- gone --> d").text() == "a < b < c é é d"
    assert page(None).text() == page("").text() == page("<script>only</script>").text() == ""
    assert page("<p>one<p>two</p></b></div>three").text() == "one\ntwo\nthree"
    assert page("<p hidden>a</p><p style='display: none'>b</p>c<style>p{}").text() == "c"
    assert page("<div class=" + '"' + "x" * 50_000 + " <p>never closed").text() is not None


def test_pages_odd_rows(spark):
    rows = [(None, None, None), (1, "no url", "<p>x"), (1, "no url", "<p>x"), (2, "http://h/", ""), (3, "http://h/", "<p>" + "y " * 200_000)]
    out = html_template.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 1, 1, 399_999]
    assert html_template.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages(spark, sf):
    import html as h

    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html_template.op6(spark, sf).collect()}
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>|<br>", inner)]
        assert got[p.page_id] == "\n".join(b for b in parts if b)


def test_segments_are_found_in_linear_time():
    """Telling words that stand alone, the usual case, and steps that are joined late."""
    def took(n, line):
        start = time.perf_counter()
        found = toxicity.segments([20 * i for i in range(n)], line(n), -0.5)
        return time.perf_counter() - start, len(found)

    alone, n = took(200_000, lambda n: [3.0] * n)
    assert n == 200_000 and alone < 2
    falling, _ = took(200_000, lambda n: [9.4 + 1e-6 * i for i in range(n)])
    assert falling < 2
    mixed, _ = took(200_000, lambda n: [(7 * i % 23) - 6.0 for i in range(n)])
    assert mixed < 2


def test_a_letter_is_of_a_letter_category():
    import unicodedata

    for code in [*range(0x3000), *range(0x1F600, 0x1F640), 0x4E00, 0xAC00, 0x10400]:
        assert language.has_letter(chr(code)) == unicodedata.category(chr(code)).startswith("L")
    assert not any(map(language.has_letter, (None, "", "² ½ ① Ⅷ", "12 !!", "__"))) and language.has_letter("1 é")

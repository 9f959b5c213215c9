"""Quality rules by divergence from language references.

Each language's reference holds the shares of character classes and of its most
common words over all its documents. A document fails if its own shares
lie too far from the reference in Jensen-Shannon distance. Base rules on length
and repetition come first.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chatlens.llm import common

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Share of words in repeated windows, in hundredths, above which a document fails.
MAX_REPEAT = 50
#: Character-class distance allowed, and the code points a text needs to be judged by it.
MAX_CLASS_DISTANCE = 0.30
MIN_CHARS = 200
#: Common-word distance allowed to a long text, what chance adds (over the root of the
#: number of words), and the words a text needs to be judged by it.
MAX_WORD_DISTANCE = 0.35
WORD_NOISE = 1.3
MIN_COMMON = 100
#: Common words of a reference.
TOP_WORDS = 64
#: Reference of all languages together, for documents whose language is null.
ALL = "*"

_ASCII = ("lower", "upper", "digit", "space", "stop", "symbol", "control")
# Scripts as the names of their letters begin, and first letters of the other categories.
SCRIPTS = (
    "LATIN GREEK CYRILLIC ARMENIAN GEORGIAN HEBREW ARABIC DEVANAGARI BENGALI GURMUKHI GUJARATI TAMIL TELUGU KANNADA "
    "MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR ETHIOPIC KHMER HANGUL HIRAGANA KATAKANA CJK".split()
)
_KINDS = ("N", "P", "S", "Z", "C")
#: Classes of code points: those of ASCII, then letters and marks by script, then all else by category.
CLASSES = (*_ASCII, *SCRIPTS, "other script", *_KINDS)


def _class_of(c: int) -> int:
    ch = chr(c)
    if ch.islower():
        return 0
    if ch.isupper():
        return 1
    if ch.isdigit():
        return 2
    if ch in " \t\n\r\x0b\x0c":
        return 3
    if ch in ".,;:!?'\"()-":
        return 4
    return 5 if c >= 0x20 and c != 0x7F else 6


@cache
def _class_beyond(c: int) -> int:
    """Class of a code point beyond ASCII."""
    kind = unicodedata.category(chr(c))[0]
    if kind in _KINDS:
        return len(CLASSES) - len(_KINDS) + _KINDS.index(kind)
    script = unicodedata.name(chr(c), "").split(" ")[0]
    return len(_ASCII) + (SCRIPTS.index(script) if script in SCRIPTS else len(SCRIPTS))


_FOLD = np.eye(len(CLASSES), dtype=np.int64)[[_class_of(c) for c in range(0x80)]]


def classes(text: str, data: bytes) -> np.ndarray:
    """Counts of code points by class; ``data`` is the text in UTF-8."""
    found = np.bincount(np.frombuffer(data, np.uint8), minlength=256)[:0x80] @ _FOLD
    if len(data) > len(text):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        for c, n in zip(*(a.tolist() for a in np.unique(points[points >= 0x80], return_counts=True))):
            found[_class_beyond(c)] += n
    return found


def base(text: str | None, data: bytes) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    again = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        at = np.array([i for i, w in enumerate(windows) if times[w] > 1])
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[at + k] = True
        again = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), again


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two count vectors; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(a):
        on = a > 0
        return float((a[on] * np.log2(a[on] / m[on])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def reference_of(lang: str | None) -> str:
    """The reference a language is judged by; one that starts with ``*`` gets another, so none is ``ALL``."""
    return ALL if lang is None else ALL + lang if lang.startswith(ALL) else lang


def references(docs: DataFrame) -> dict:
    """``{language: (class counts, {word: place}, word counts with the rest last)}``.

    Counts cover every document. Each batch sends one row for each class and for
    each word of each language, so what is shuffled follows the vocabulary. The driver gets ``TOP_WORDS`` rows and the classes for each
    language.
    """

    def counted(batches):
        for batch in batches:
            by: dict[str, tuple[np.ndarray, Counter]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    data = text.encode("utf-8", "surrogatepass")
                    words = Counter(common.plain_words(text))
                    for key in {reference_of(lang), ALL}:
                        held = by.setdefault(key, (np.zeros(len(CLASSES), np.int64), Counter()))
                        held[0][:] += classes(text, data)
                        held[1].update(words)
            rows = []
            for lang, (kinds, words) in by.items():
                rows += [(lang, f"\t{i}".encode(), int(n)) for i, n in enumerate(kinds) if n]
                rows.append((lang, b"\tall", sum(words.values())))
                rows += [(lang, w, n) for w, n in words.items()]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], ["lang", "what", "n"]
            )

    counts = docs.select("lang", "text").mapInArrow(counted, "lang string, what binary, n long").groupBy("lang", "what").agg(F.sum("n").alias("n"))
    counts = common.cut(counts)
    is_class = F.substring(F.col("what"), 1, 1) == F.lit(b"\t")
    place = Window.partitionBy("lang").orderBy(F.desc("n"), "what")
    top = counts.where(~is_class).withColumn("place", F.row_number().over(place)).where(F.col("place") <= TOP_WORDS).drop("place")
    refs: dict = {}
    for lang, what, n in counts.where(is_class).union(top).collect():  # TOP_WORDS and the classes, for each language
        kinds, totals, words = refs.setdefault(lang, (np.zeros(len(CLASSES)), [0], {}))
        what = bytes(what)
        if what == b"\tall":
            totals[0] = n
        elif what[:1] == b"\t":
            kinds[int(what[1:])] = n
        else:
            words[what] = n
    return {
        lang: (kinds, {w: i for i, w in enumerate(sorted(words))},
               np.array([words[w] for w in sorted(words)] + [totals[0] - sum(words.values())], float))
        for lang, (kinds, totals, words) in refs.items()
    }


def judged(docs: DataFrame, refs: dict, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """``doc_id, n_words``, the base counts, ``base_failed``, both distances and ``kept``.

    A null or empty text has no words and fails. A null language is judged by
    the reference of all. Texts shorter than the guards are not judged by that
    distance (their distance is null). Repeated rows each get the same verdict.
    """
    shared = docs.sparkSession.sparkContext.broadcast(refs)
    schema = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, class_distance double, word_distance double, kept boolean")

    def run(batches):
        held = shared.value
        for batch in batches:
            out = []
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                data = text.encode("utf-8", "surrogatepass") if text else b""
                n, chars, symbols, dup, again = base(text, data)
                failed = n < MIN_WORDS or 100 * again > MAX_REPEAT * n
                kinds, places, common_n = held.get(reference_of(lang)) or (None, None, None)
                by_class = by_word = None
                if kinds is not None and chars >= MIN_CHARS:
                    by_class = distance(classes(text, data), kinds)
                if kinds is not None and n >= MIN_COMMON:
                    own = np.zeros(len(common_n))
                    words = common.plain_words(text)
                    np.add.at(own, [places.get(w, -1) for w in words], 1)
                    by_word = distance(own, common_n)
                bad = failed or (by_class or 0) > max_class or (by_word or 0) > max_word + WORD_NOISE / max(n, 1) ** 0.5
                out.append((doc_id, n, chars, symbols, dup, again, failed, by_class, by_word, not bad))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            cols = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, references(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "class_distance", "word_distance",
    )

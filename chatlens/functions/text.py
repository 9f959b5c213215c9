"""Character classes and small text expressions shared by all functions.

The classes are spelled out instead of using ``\\b``, ``\\w`` and ``\\s``: their
meaning differs between Java releases and between ASCII and Unicode mode,
while letters and numbers plus underscore, and the white-space list below,
mean the same on every JVM.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
DIGIT = r"\p{Nd}"
# A-Z under case folding also covers dotted/dotless i, long s and the Kelvin sign.
LETTER = r"[A-Za-z\u0130\u0131\u017f\u212a]"

WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Single characters one by one: Java looks these up in a table, where it compares
# ranges and properties one after the other. Most characters are told by them alone.
ASCII_WORD = string.ascii_letters + string.digits + "_"

NOT_AFTER_WORD = f"(?<![{ASCII_WORD}])(?<!{WORD})"
NOT_BEFORE_WORD = f"(?![{ASCII_WORD}])(?!{WORD})"

_FOLDED = {"i": r"[iI\u0130\u0131]", "s": r"[sS\u017f]", "k": r"[kK\u212a]"}


def fill(pattern: str) -> str:
    """Any-case pattern from the vocabulary with its Unicode classes filled in.

    The classes hold both cases already, so case folding is switched off for
    them: a folded range costs two conversions per character. Letters and
    spaces are matched possessively; what follows them can never be a letter
    or a space again, so giving characters back would only waste time.
    """
    plain, folded = "(?-iu)", "(?iu)"
    return folded + (
        pattern.replace("<space>+", f"{plain}{SPACE}++{folded}")
        .replace("<letter>{2,6}", f"{plain}{LETTER}{{2,6}}+{folded}")
        .replace("<digit>+", f"{plain}{DIGIT}++{folded}")
        .replace("<word>+", f"{plain}{WORD}++{folded}")
    )


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def first_words(c: Column, n: int) -> Column:
    """First ``n`` words of a stripped text; the rest of it is never split."""
    return F.slice(F.split(c, f"(?![{ASCII_WORD}]){SPACE}+", n + 1), 1, n)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def _letter(ch: str, any_case: bool) -> str:
    if ch.isalpha():
        if not any_case:
            return ch
        return _FOLDED.get(ch.lower(), f"[{ch.lower()}{ch.upper()}]")
    return ch if ch in " _" or ch.isdigit() else "\\" + ch


def prefix_tree(words: Iterable[str], any_case: bool = False) -> str:
    """Alternation of literal words that share their common prefixes.

    A flat ``a|b|c`` of many words makes the regex engine try each word at
    each position; grouped by first letter it tries one branch. Longer words
    come before their own prefixes, so a caller's right-hand boundary decides.
    """
    groups: dict[str, list[str]] = {}
    for word in words:
        groups.setdefault(word[:1], []).append(word[1:])
    ends_here = groups.pop("", None) is not None
    if not groups:
        return ""
    branches = [_letter(ch, any_case) + prefix_tree(rest, any_case) for ch, rest in groups.items()]
    body = branches[0] if len(branches) == 1 and not ends_here else f"(?:{'|'.join(branches)})"
    return body + ("?" if ends_here else "")


def first_letters(words: Iterable[str], any_case: bool = False) -> str:
    """Look-ahead for the first character of any of ``words``.

    In front of a look-behind it spares that one at most positions of a text.
    """
    firsts = dict.fromkeys(_letter(w[0], any_case).strip("[]") for w in words)
    return f"(?=[{''.join(firsts)}])"


def whole_words(words: Iterable[str], any_case: bool = False) -> str:
    """Pattern for any of ``words`` standing alone; entries holding ``.?`` are
    patterns themselves (``.`` stands for anything but a line feed)."""
    words = list(words)
    plain = [w for w in words if ".?" not in w]
    special = [w.replace(".?", "[^\\n]?") for w in words if ".?" in w]
    options = ([prefix_tree(plain, any_case)] if plain else []) + special
    return f"{first_letters(words, any_case)}{NOT_AFTER_WORD}(?:{'|'.join(options)}){NOT_BEFORE_WORD}"

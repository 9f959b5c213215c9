"""Key points: short phrases taken from a text or from a model's reply."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions import vocabulary as V
from chatlens.functions.text import ASCII_WORD, SPACE, fill, let, strip

# The look-ahead passes over the characters that most texts consist of.
NOISE = rf"(?![{ASCII_WORD} .,!?$%\-])[^a-zA-Z0-9_\p{{L}}\p{{N}}{SPACE[1:-1]}.,!?$%\-]"

# Texts of such characters only have neither symbols nor links.
PLAIN = rf"\A[{ASCII_WORD} \t\n\r.,!?$%\-]*+\z"

_EMPTY = "array<string>"


def clean_text(text: Column) -> Column:
    """Text without URLs and without symbols such as emoji."""
    linked = F.contains(text, F.lit("://"))
    bare = F.regexp_replace(F.when(linked, F.regexp_replace(text, V.URL, "")).otherwise(text), NOISE, "")
    return F.when(text.rlike(PLAIN), text).otherwise(bare)


def _signed(low: Column, signs: tuple[str, ...]) -> Column:
    """Whether a lower-cased text holds one of ``signs``: a search of bytes, where a
    pattern is tried at every letter."""
    return reduce(or_, [F.contains(low, F.lit(s)) for s in signs])


def _between(bounds: tuple[int, int]):
    low, high = bounds
    return lambda p: F.length(p).between(low, high)


_WORD_LEAD = r"\$?<letter>{2,6}<space>+"


def _hits(cleaned: Column, pattern: str) -> Column:
    """All matches of one pattern.

    A pattern led by "any short word" makes the engine try every letter of a
    text. What follows the lead is rarer and quicker to find, and a text
    without it cannot match, so it is looked for first.
    """
    found = F.regexp_extract_all(cleaned, F.lit(fill(pattern)), F.lit(0))
    if not pattern.startswith(_WORD_LEAD):
        return found
    rest = fill(pattern.removeprefix(_WORD_LEAD))
    return F.when(cleaned.rlike(rest), found).otherwise(F.array().cast(_EMPTY))


def _matches(
    cleaned: Column, low: Column | None, patterns: tuple[str, ...], signs: tuple[tuple[str, ...], ...], lengths: tuple[int, int]
) -> Column:
    low = F.lower(cleaned) if low is None else low
    none = F.array().cast(_EMPTY)
    each = [F.when(~_signed(low, s), none).otherwise(_hits(cleaned, p)) for p, s in zip(patterns, signs, strict=True)]
    unsigned = ~reduce(or_, [_signed(low, s) for s in signs])
    return F.when(unsigned, none).otherwise(F.filter(F.concat(*each), _between(lengths)))


def price_points(cleaned: Column, low: Column | None = None) -> Column:
    """``low`` is the text in lower case, where the caller has it."""
    return _matches(cleaned, low, V.PRICE_PATTERNS, V.PRICE_SIGNS, V.PRICE_LENGTHS)


def performance_points(cleaned: Column, low: Column | None = None) -> Column:
    return _matches(cleaned, low, V.PERFORMANCE_PATTERNS, V.PERFORMANCE_SIGNS, V.PERFORMANCE_LENGTHS)


def _finds(cleaned: Column, low: Column, pattern: str, signs: tuple[str, ...]) -> Column:
    """Gaps before, hits, and right-hand neighbours of a pattern; null if it is absent.

    Right-hand characters come from a look-ahead, which consumes none.
    """
    hit = fill(pattern)
    beyond = f"(?:{hit})(?=([\\s\\S]{{0,{V.CATALYST_CONTEXT}}}))"
    return F.when(
        _signed(low, signs) & cleaned.rlike(hit),
        F.struct(
            F.split(cleaned, hit).alias("gaps"),
            F.regexp_extract_all(cleaned, F.lit(hit), F.lit(0)).alias("hits"),
            F.regexp_extract_all(cleaned, F.lit(beyond), F.lit(1)).alias("after"),
        ),
    )


def _contexts(f: Column) -> Column:
    """Every hit with up to 15 characters on either side.

    The text before a hit is the gap since the previous hit, and, where that
    gap is short, the tail of what precedes it. Hits have seven letters or
    more, so three earlier pieces always hold 15 characters; each hit thus
    looks at a fixed number of neighbours and a text with many hits stays
    linear.
    """
    width = V.CATALYST_CONTEXT
    n = F.size(f["hits"])
    gaps = F.slice(f["gaps"], F.lit(1), n)
    padded = F.concat(
        F.array_repeat(F.lit(""), 3), F.zip_with(gaps, f["hits"], lambda g, h: F.concat(g, h))
    )

    def context(r: Column) -> Column:
        before = F.concat(r["p3"], r["p2"], r["p1"], r["gap"])
        return strip(F.concat(F.substring(before, -width, width), r["hit"], r["after"]))

    def neighbours(p: Column) -> Column:
        return F.arrays_zip(
            gaps.alias("gap"), f["hits"].alias("hit"), f["after"].alias("after"),
            F.slice(p, F.lit(1), n).alias("p3"), F.slice(p, F.lit(2), n).alias("p2"),
            F.slice(p, F.lit(3), n).alias("p1"),
        )

    return let(padded, lambda p: F.transform(neighbours(p), context))


def catalyst_points(cleaned: Column, low: Column | None = None) -> Column:
    low = F.lower(cleaned) if low is None else low
    pairs = list(zip(V.CATALYST_PATTERNS, V.CATALYST_SIGNS, strict=True))
    finds = F.array_compact(F.array(*[_finds(cleaned, low, p, s) for p, s in pairs]))
    found = F.filter(F.flatten(F.transform(finds, _contexts)), _between(V.CATALYST_LENGTHS))
    any_hit = reduce(or_, [_signed(low, s) & cleaned.rlike(fill(p)) for p, s in pairs])
    return F.when(any_hit, found).otherwise(F.array().cast(_EMPTY))


def first_of(points: Column, most: int | None) -> Column:
    return points if most is None else F.slice(points, 1, most)


def text_points(cleaned: Column, most: int | None = V.MAX_KEY_POINTS, low: Column | None = None) -> Column:
    """First ``most`` distinct points (None: all): prices, then performance, then catalysts."""
    everything = F.concat(
        price_points(cleaned, low), performance_points(cleaned, low), catalyst_points(cleaned, low)
    )
    return first_of(F.array_distinct(everything), most)


def reply_points(reply: Column, most: int | None = V.MAX_KEY_POINTS) -> Column:
    """First ``most`` insights of a model's reply (None: all): one per line, bullets and numbers removed."""
    lines = F.transform(F.split(strip(reply), "\n"), strip)
    bare = F.transform(
        lines, lambda x: strip(F.regexp_replace(x, rf"\A[-•*\p{{Nd}}+.){SPACE[1:-1]}]+", ""))
    )

    def wanted(x: Column) -> Column:
        ok = F.length(x).between(*V.REPLY_LENGTHS)
        for phrase in V.REPLY_STOP_PHRASES:
            ok = ok & ~F.contains(F.lower(x), F.lit(phrase))
        return ok

    unquoted = F.transform(F.filter(bare, wanted), lambda x: F.btrim(x, F.lit("\"'")))
    points = first_of(F.filter(unquoted, lambda x: x != ""), most)
    return F.coalesce(points, F.array().cast(_EMPTY))


def choose_points(is_investment: Column, from_reply: Column, from_text: Column) -> Column:
    """Reply points if there are any, else points found in the text itself."""
    return F.when(
        is_investment, F.when(F.size(from_reply) > 0, from_reply).otherwise(from_text)
    ).otherwise(F.array().cast(_EMPTY))


def insight_prompt(
    token_list: Column, sentiment: Column, text: Column, max_chars: int | None = None
) -> Column:
    """Prompt text for a batch of model calls made elsewhere; the whole message
    unless ``max_chars`` shortens it."""
    named = F.when(F.size(token_list) > 0, F.array_join(token_list, ", ")).otherwise(
        F.lit(V.PROMPT_NO_TOKENS)
    )

    def around(parts: tuple[str, str]) -> Column:
        return F.concat(F.lit(parts[0]), named, F.lit(parts[1]))

    about = (
        F.when(F.size(token_list) > 3, around(V.PROMPT_MANY_TOKENS))
        .when(F.size(token_list) > 1, around(V.PROMPT_SOME_TOKENS))
        .otherwise(around(V.PROMPT_ONE_TOKEN))
    )
    mood = (
        F.when(sentiment == V.BULLISH, F.lit(V.PROMPT_SENTIMENT[V.BULLISH]))
        .when(sentiment == V.BEARISH, F.lit(V.PROMPT_SENTIMENT[V.BEARISH]))
        .when(sentiment == V.NEUTRAL, F.lit(V.PROMPT_SENTIMENT[V.NEUTRAL]))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.lit(V.PROMPT_HEAD), about, mood, F.lit('\n\nMessage: "'),
        text if max_chars is None else F.substring(text, 1, max_chars), F.lit('"'), F.lit(V.PROMPT_RULES),
    )

"""Asset tokens of a text: cashtags and spelled-out names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions import vocabulary as V
from chatlens.functions.text import NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD, first_letters, prefix_tree, whole_words

CASHTAG = V.CASHTAG + NOT_BEFORE_WORD
_MONEY = f"(?!(?:{'|'.join(V.MONEY_SUFFIXES)}){NOT_BEFORE_WORD})"
ASSET_CASHTAG = CASHTAG.replace(r"\$", rf"\${_MONEY}", 1)

_NAMES = {name: token for token, names in V.TOKEN_ALIASES.items() for name in names}
_WORD_NAMES = [name for name in _NAMES if name.isalpha()]
_SIGN_NAMES = [name for name in _NAMES if not name.isalpha()]
# A word boundary next to a sign needs a word character on the sign's other side.
_STANDING = "|".join(
    [f"{NOT_AFTER_WORD}{prefix_tree(_WORD_NAMES)}{NOT_BEFORE_WORD}"]
    + [f"(?<={WORD}){name}(?={WORD})" for name in _SIGN_NAMES]
)
ALIAS = f"{first_letters(_NAMES)}(?:{_STANDING})"


def cashtags(upper_text: Column) -> Column:
    """All ``$XYZ`` marks of an upper-cased text, repeats kept."""
    return F.regexp_extract_all(upper_text, F.lit(CASHTAG), F.lit(1))


def _asset_marks(upper_text: Column) -> Column:
    """Cashtags that are not amounts of money, repeats kept."""
    return F.regexp_extract_all(upper_text, F.lit(ASSET_CASHTAG), F.lit(1))


def asset_cashtags(upper_text: Column) -> Column:
    """Distinct cashtags that are not amounts of money."""
    return F.array_distinct(_asset_marks(upper_text))


def alias_tokens(upper_text: Column) -> Column:
    """Tokens whose spelled-out name stands in an upper-cased text."""
    found = F.regexp_extract_all(upper_text, F.lit(ALIAS), F.lit(0))

    def token_of(name: Column) -> Column:
        choice = F.lit(None).cast("string")
        for alias, token in _NAMES.items():
            choice = F.when(name == alias, token).otherwise(choice)
        return choice

    return F.array_distinct(F.transform(found, token_of))


def alias_tokens_if_any(upper_text: Column) -> Column:
    """As ``alias_tokens``; the pattern and the per-hit lambda are for texts that hold a name, a search of bytes."""
    held = reduce(or_, [F.contains(upper_text, F.lit(name)) for name in _NAMES])
    return F.when(held, alias_tokens(upper_text)).otherwise(
        F.array().cast("array<string>")
    )


def tokens(upper_text: Column) -> Column:
    """Sorted distinct tokens of an upper-cased text."""
    marked = F.when(F.contains(upper_text, F.lit("$")), _asset_marks(upper_text)).when(
        upper_text.isNotNull(), F.array().cast("array<string>")
    )
    return F.sort_array(F.array_union(marked, alias_tokens_if_any(upper_text)))


FINANCE = whole_words(V.FINANCE_KEYWORDS, any_case=True)


def finance_hits(text: Column) -> Column:
    """How many finance words stand in the text, repeats counted."""
    return F.regexp_count(text, F.lit(FINANCE))


def is_investment(token_list: Column, text: Column) -> Column:
    """A token, or at least two finance words; words are only counted if needed."""
    return F.when(F.size(token_list) > 0, F.lit(True)).otherwise(finance_hits(text) >= 2)

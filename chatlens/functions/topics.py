"""Topic key of a message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatlens.functions.text import first_words, let


def topic_key(token_list: Column, text: Column) -> Column:
    """First token; else up to three longer words among the first ten."""
    def phrase(words: Column) -> Column:
        telling = F.slice(F.filter(words, lambda w: F.length(w) > 3), 1, 3)
        return F.when(F.size(words) >= 3, F.upper(F.array_join(telling, "_"))).otherwise(F.lit(""))

    # texts without a token are split once
    said = let(let(first_words(text, 10), phrase), lambda p: F.when(p != "", p).otherwise(F.lit("GENERAL")))
    return F.when(F.size(token_list) > 0, F.get(token_list, F.lit(0))).otherwise(said)

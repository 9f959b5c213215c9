"""The text rules as DuckDB SQL, written from the vocabulary alone."""

from __future__ import annotations

from chatlens.functions import vocabulary as V


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def ascii_words(expr: str) -> str:
    """Letters and numbers outside ASCII become ``q``, other such characters
    ``#``: RE2's word boundary only knows ASCII."""
    letters = r"regexp_replace({}, '[^\x00-\x7F\P{{L}}]', 'q', 'g')".format(expr)
    numbers = r"regexp_replace({}, '[^\x00-\x7F\P{{N}}]', 'q', 'g')".format(letters)
    return r"regexp_replace({}, '[^\x00-\x7F]', '#', 'g')".format(numbers)


CASHTAGS = r"regexp_extract_all({up}, '\$([A-Z][A-Z0-9_]{{1,9}})\b', 1)"


def cashtags(up: str) -> str:
    return CASHTAGS.format(up=up)


def asset_cashtags(up: str) -> str:
    money = ", ".join(lit(m) for m in V.MONEY_SUFFIXES)
    return f"list_filter({cashtags(up)}, lambda x: x NOT IN ({money}))"


def aliases(up: str) -> str:
    cases = [
        rf"CASE WHEN regexp_matches({up}, '\b{name}\b') THEN '{token}' END"
        for token, names in V.TOKEN_ALIASES.items()
        for name in names
        if name.isascii()
    ]
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


def tokens(up: str) -> str:
    return f"list_sort(list_distinct(list_concat({asset_cashtags(up)}, {aliases(up)})))"


def finance_hits(text: str) -> str:
    words = "|".join(V.FINANCE_KEYWORDS)
    return rf"len(regexp_extract_all({text}, '(?i)\b(?:{words})\b'))"


def family_score(low: str, families: tuple) -> str:
    return " + ".join(
        rf"regexp_matches({low}, '\b(?:{'|'.join(f)})\b')::INT" for f in families
    )


def topic(tok: str, text: str) -> str:
    words = rf"list_slice(string_split_regex({text}, '\s+'), 1, 10)"
    telling = f"list_slice(list_filter({words}, lambda w: length(w) > 3), 1, 3)"
    phrase = f"upper(replace(array_to_string({telling}, '_'), 'ß', 'SS'))"
    return (
        f"CASE WHEN len({tok}) > 0 THEN {tok}[1] "
        f"WHEN len({words}) >= 3 AND {phrase} <> '' THEN {phrase} ELSE 'GENERAL' END"
    )


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def clean(text: str) -> str:
    return (
        rf"regexp_replace(regexp_replace({text}, '{V.URL}', '', 'g'), "
        r"'[^\p{L}\p{N}_\s.,!?$%\-]', '', 'g')"
    )


def _fill(p: str) -> str:
    return (
        p.replace("<space>", r"\s").replace("<digit>", r"\d")
        .replace("<letter>", "[A-Z]").replace("<word>", r"[\p{L}\p{N}_]")
    )


def matches(text: str, patterns: tuple, lengths: tuple) -> str:
    hits = [f"regexp_extract_all({text}, '(?i){_fill(p)}')" for p in patterns]
    # DuckDB's list_concat takes any number of lists.
    return (
        f"list_filter(list_concat({', '.join(hits)}), "
        f"lambda x: length(x) BETWEEN {lengths[0]} AND {lengths[1]})"
    )


def catalyst_ctes(source: str, key: str, text: str) -> str:
    """CTEs ending in ``catalysts(key, points)``: hit positions by running sums
    of gap and hit lengths, contexts cut by position, in pattern then text order."""
    parts = []
    for n, p in enumerate(V.CATALYST_PATTERNS):
        pat = f"(?i){_fill(p)}"
        parts.append(
            f"SELECT {key} AS k, {n} AS pat, {text} AS t, "
            f"unnest(string_split_regex({text}, '{pat}')) AS gap, "
            f"unnest(list_concat(regexp_extract_all({text}, '{pat}'), [NULL])) AS hit, "
            f"generate_subscripts(string_split_regex({text}, '{pat}'), 1) AS i FROM {source} "
            f"WHERE regexp_matches({text}, '{pat}')"
        )
    w = V.CATALYST_CONTEXT
    return (
        f"pieces AS ({' UNION ALL '.join(parts)}), "
        "placed AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) "
        "OVER (PARTITION BY k, pat ORDER BY i) - coalesce(length(hit), 0) AS hit_start FROM pieces), "
        f"cut AS (SELECT k, pat, i, trim(substring(t, greatest(hit_start - {w}, 0)::BIGINT + 1, "
        f"(least(hit_start, {w}) + length(hit) + {w})::BIGINT), chr(9) || chr(10) || chr(13) || ' ') AS ctx "
        "FROM placed WHERE hit IS NOT NULL), "
        "catalysts AS (SELECT k, list(ctx ORDER BY pat, i) AS points FROM cut "
        f"WHERE length(ctx) BETWEEN {V.CATALYST_LENGTHS[0]} AND {V.CATALYST_LENGTHS[1]} GROUP BY k)"
    )


def annotated(name: str, source: str, keys: str, text: str = "text", with_topic: bool = True) -> str:
    """CTE ``name`` with tokens, flag, keyword scores and topic of every row."""
    up, low, body = f"upper({text})", f"lower({text})", strip(text)
    return (
        f"{name}_t AS (SELECT *, {tokens(up)} AS tokens, {finance_hits(text)} AS hits, "
        f"{family_score(low, V.BULLISH_FAMILIES)} AS bull, "
        f"{family_score(low, V.BEARISH_FAMILIES)} AS bear FROM {source}), "
        f"{name} AS (SELECT *, (len(tokens) > 0 OR hits >= 2) AS is_investment, "
        "CASE WHEN bull > bear THEN 'BULLISH' WHEN bear > bull THEN 'BEARISH' ELSE 'NEUTRAL' END AS keyword, "
        f"{topic('tokens', body)} AS topic_key FROM {name}_t)"
    )


def first_points(price: str, performance: str, catalysts: str) -> str:
    """First two distinct points in order, without relying on list_distinct's order."""
    everything = f"list_concat({price}, {performance}, {catalysts})"
    return (
        f"CASE WHEN len({everything}) = 0 THEN [] ELSE list_slice(list_filter({everything}, "
        f"lambda x, i: list_position({everything}, x) = i), 1, 2) END"
    )


def lexicon_verdict() -> tuple[str, str]:
    """Sentiment and confidence columns when no model ran but keywords decide."""
    return (
        "CASE WHEN is_investment THEN keyword ELSE 'NEUTRAL' END",
        "CASE WHEN NOT is_investment THEN NULL WHEN keyword <> 'NEUTRAL' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END",
    )


def analysed_ctes() -> str:
    """messages -> analysed(…, key_points), in lexicon mode."""
    s, c = lexicon_verdict()
    pts = first_points(
        matches("clean", V.PRICE_PATTERNS, V.PRICE_LENGTHS),
        matches("clean", V.PERFORMANCE_PATTERNS, V.PERFORMANCE_LENGTHS),
        "coalesce(c.points, [])",
    )
    return (
        f"{annotated('flagged', 'messages', 'message_id')}, "
        f"cleaned AS (SELECT *, {clean(strip('text'))} AS clean FROM flagged), "
        f"{catalyst_ctes('cleaned', 'message_id', 'clean')}, "
        f"analysed AS (SELECT m.* EXCLUDE (clean), {s} AS sentiment, {c} AS confidence, "
        f"CASE WHEN is_investment THEN {pts} ELSE [] END AS key_points "
        "FROM cleaned m LEFT JOIN catalysts c ON c.k = m.message_id)"
    )

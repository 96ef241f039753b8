"""DuckDB expression builders mirroring ``tessera.functions`` (oracle side)."""

from __future__ import annotations

import re

# Written out apart from the patterns under test.
_MARKUP = [
    (r"```[\s\S]*?```", " "),
    (r"`[^`]*`", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
    (r"<[^>]+>", " "),
]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_ws(e: str) -> str:
    return rf"regexp_replace(regexp_replace({e}, '^\s+', ''), '\s+$', '')"


def combined_text(title: str, body: str, n: int | None) -> str:
    b = f"coalesce({body}, '')"
    if n is not None:
        b = f"substring({b}, 1, {n})"
    return strip_ws(f"(coalesce({title}, '') || ' ' || {b})")


def occurrences(low: str, k: str) -> str:
    return f"CAST((length({low}) - length(replace({low}, {q(k)}, ''))) // {len(k)} AS INTEGER)"


def keyword_occurrences(e: str, kws: list[str]) -> str:
    low = f"lower({e})"
    return "(" + " + ".join(occurrences(low, k.lower()) for k in kws) + ")"


def keyword_distinct(e: str, kws: list[str]) -> str:
    low = f"lower({e})"
    uniq = list(dict.fromkeys(k.lower() for k in kws))
    return "(" + " + ".join(f"CAST(contains({low}, {q(k)}) AS INTEGER)" for k in uniq) + ")"


# Unicode-aware word boundary (Java ``(?U)\b``) spelled out for RE2.
_W = r"[\pL\pN\pM_]"


def word_match(e: str, word: str) -> str:
    w = re.escape(word)
    return f"regexp_matches({e}, {q('(^|[^' + _W[1:-1] + '])' + w + '($|[^' + _W[1:-1] + '])')})"


def stem_hits(e: str, stems: list[str], exact: list[str]) -> str:
    low = f"lower({e})"
    ex = {x.lower() for x in exact}
    parts = []
    for s in dict.fromkeys(k.lower() for k in stems):
        if s in ex:
            parts.append(f"CAST(contains({low}, {q(s)}) AND {word_match(low, s)} AS INTEGER)")
        else:
            parts.append(f"CAST(contains({low}, {q(s)}) AS INTEGER)")
    return "(" + " + ".join(parts) + ")"


def markdown_to_text(e: str) -> str:
    out = e
    for pat, repl in _MARKUP:
        out = f"regexp_replace({out}, {q(pat)}, {q(repl)}, 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def words(e: str) -> str:
    return rf"list_filter(string_split_regex({strip_ws(e)}, '\s+'), lambda w: w <> '')"


def word_count(e: str) -> str:
    return rf"CAST(len(regexp_extract_all({e}, '\S+')) AS INTEGER)"


def space_token_count(e: str) -> str:
    return f"CAST(len(string_split({e}, ' ')) AS INTEGER)"


def polarity_label(e: str, cut: float, inclusive: bool) -> str:
    ge, le = (">=", "<=") if inclusive else (">", "<")
    return (f"CASE WHEN {e} {ge} {cut} THEN 'positive' WHEN {e} {le} -{cut} THEN 'negative' "
            f"ELSE 'neutral' END")


def unicode_regex(pattern: str) -> str:
    """Translate a ``\\b``/``\\w`` regex to RE2 with Java ``(?U)`` meaning:
    word characters are letters, digits, marks and underscore."""
    w = _W[1:-1]
    alts = []
    for a in pattern.split("|"):
        pre = suf = ""
        if a.startswith(r"\b"):
            a, pre = a[2:], f"(^|[^{w}])"
        if a.endswith(r"\b"):
            a, suf = a[:-2], f"($|[^{w}])"
        alts.append(pre + a.replace(r"\w", f"[{w}]") + suf)
    return "|".join(alts)


def regex_match(e: str, pattern: str) -> str:
    return f"regexp_matches({e}, {q(unicode_regex(pattern))})"

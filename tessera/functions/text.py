"""Text functions as native Column expressions (JVM-side, codegen; no UDF).

Regexes always use ``(?U)`` so ``\\b``, ``\\w`` and ``\\s`` are Unicode-aware
like Python's ``re``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schemas import MARKUP_REWRITES

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_if_null(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c), F.lit(""))


#: The characters of ``(?U)\\s``: Unicode's White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c: ColumnOrName) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace,
    reading no further than that (a pattern would try every place of the text)."""
    return F.trim(_c(c), F.lit(WHITE_SPACE))


def is_blank(c: ColumnOrName) -> Column:
    """Null, or nothing but whitespace."""
    return _c(c).isNull() | (strip_ws(c) == "")


def space_token_count(c: ColumnOrName) -> Column:
    """``len(text.split(" "))``: split on single spaces, empty pieces count."""
    return F.size(F.split(_c(c), " ", -1))


def word_count(c: ColumnOrName) -> Column:
    """``len(text.split())``: runs of non-whitespace.  Null stays null."""
    return F.regexp_count(_c(c), F.lit(r"(?U)\S+"))


def words(c: ColumnOrName) -> Column:
    """``text.split()`` as an array.  Splitting on whitespace runs leaves an
    empty string only at either end (or for blank text); ``array_remove``
    drops those without a lambda or a second regex pass."""
    return F.array_remove(F.split(_c(c), r"(?U)\s+"), "")


def combined_text(title: ColumnOrName, body: ColumnOrName, max_chars: int | None) -> Column:
    """``(title + " " + body[:max_chars]).strip()`` with nulls as empty."""
    b = empty_if_null(body)
    if max_chars is not None:
        b = F.substring(b, 1, max_chars)
    return strip_ws(F.concat(empty_if_null(title), F.lit(" "), b))


def embedding_text(title: ColumnOrName, *bodies: ColumnOrName, max_chars: int = 1500,
                   default: str = "No content") -> Column:
    """Title plus the first non-empty body column (clipped); ``default`` when blank."""
    body = F.coalesce(*[F.nullif(_c(b), F.lit("")) for b in bodies], F.lit(""))
    t = combined_text(title, body, max_chars)
    return F.when(t == "", F.lit(default)).otherwise(t)


def url_fallback(url: ColumnOrName, slug: ColumnOrName, prefix: str) -> Column:
    """``url or prefix + slug``."""
    return F.coalesce(F.nullif(_c(url), F.lit("")), F.concat(F.lit(prefix), _c(slug)))


def markdown_to_text(c: ColumnOrName) -> Column:
    """Markdown / HTML to text: the fixed rewrites in order, then white space
    collapsed."""
    out = _c(c)
    for pattern, repl in MARKUP_REWRITES:
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (Python ``str.count``)."""
    if not needle:
        raise ValueError("empty keyword")
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) /
            F.lit(len(needle))).cast("int")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    Filters get no common-subexpression elimination, so a predicate that
    tests one derived string (say ``lower(text)``) against many keywords
    would recompute it per keyword; binding it through a one-element
    ``transform`` computes it once.
    """
    return F.transform(F.array(value), body)[0]


def compute_once(df, **cols: Column):
    """Add computed columns that later filters read without re-evaluating.

    A filter on a projected column is pushed below the projection with the
    expression substituted, so an expensive score used both as a predicate
    and as output runs twice.  Produced by a one-row ``inline`` (a
    Generate), the columns are computed once and the filter stays above.
    """
    names = list(cols)
    return df.select("*", F.inline(F.array(F.struct(*[cols[n].alias(n) for n in names]))))


def keyword_occurrences(text: ColumnOrName, keywords: list[str]) -> Column:
    """Sum over keywords of non-overlapping occurrences in the lower-cased text.

    A plain expression: in a projection Spark computes ``lower(text)`` once
    (subexpression elimination) inside generated code.  Inside a filter wrap
    the lowered text with ``let`` instead (see ``filters.relevance``)."""
    low = F.lower(_c(text))
    return sum((occurrences(low, k.lower()) for k in keywords), F.lit(0))


def keyword_distinct(text: ColumnOrName, keywords: list[str]) -> Column:
    """Number of distinct keywords contained in the lower-cased text (plain
    expression; see ``keyword_occurrences``)."""
    low = F.lower(_c(text))
    uniq = list(dict.fromkeys(k.lower() for k in keywords))
    return sum((low.contains(k).cast("int") for k in uniq), F.lit(0))


def word_regex(word: str) -> str:
    return r"(?U)\b" + re.escape(word) + r"\b"


def stem_hits(text: ColumnOrName, stems: list[str], exact: list[str]) -> Column:
    """Distinct stems found: substring match, whole-word match for ``exact``."""
    exact_set = {e.lower() for e in exact}

    def count(low: Column) -> Column:
        hits = []
        for s in dict.fromkeys(k.lower() for k in stems):
            hit = low.contains(s)
            if s in exact_set:
                hit = hit & low.rlike(word_regex(s))
            hits.append(hit.cast("int"))
        return sum(hits, F.lit(0))
    return let(F.lower(_c(text)), count)


def polarity_label(score: ColumnOrName, cut: float = 0.05, inclusive: bool = True,
                   null_label: str | None = None) -> Column:
    """positive / negative / neutral by a symmetric cut-off.

    ``inclusive=True`` is ``>= cut`` / ``<= -cut``; ``False`` is strict.
    """
    s = _c(score)
    pos = (s >= cut) if inclusive else (s > cut)
    neg = (s <= -cut) if inclusive else (s < -cut)
    out = F.when(pos, "positive").when(neg, "negative").otherwise("neutral")
    if null_label is not None:
        out = F.when(s.isNull(), F.lit(null_label)).otherwise(out)
    return out


def chunk_words(c: ColumnOrName, size: int) -> Column:
    """Whitespace words grouped into chunks of ``size`` (last may be shorter)."""
    empty = F.array().cast("array<array<string>>")

    def cut(w: Column) -> Column:  # the word array, split once
        return F.when(F.size(w) == 0, empty).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(size)), lambda i: F.slice(w, i + 1, size)))
    return let(words(c), cut)


def word_counts(words_array: Column) -> Column:
    """Distinct values of an array with their counts, as array<(word, n)>:
    one sort within the row, no shuffle."""
    def count(s: Column) -> Column:
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return let(first, lambda f: F.transform(
            f, lambda i, k: F.struct(F.get(s, i - 1).alias("word"),
                                     (F.coalesce(F.get(f, k + 1), n + 1) - i).alias("n"))))
    return F.when(F.size(words_array) > 0, let(F.array_sort(words_array), count))


def split_tags(c: ColumnOrName, sep: str = ",") -> Column:
    """Comma-separated tags, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(_c(c), re.escape(sep)), lambda t: F.trim(t)),
                    lambda t: t != "")


def parse_tags(c: ColumnOrName) -> Column:
    """Tags stored either as a JSON array (``["ai","ml"]``) or as
    comma-separated text; JSON is parsed as JSON so brackets and quotes never
    end up inside tags.  Blank tags are dropped."""
    col = _c(c)
    as_json = F.from_json(col, "array<string>")
    parsed = F.when(F.trim(col).startswith("[") & as_json.isNotNull(),
                    F.filter(F.transform(as_json, lambda t: F.trim(t)), lambda t: t != ""))
    return parsed.otherwise(split_tags(col))

"""Row filters and predicates as boolean Columns.

Cheap conjuncts come first (``contains`` before ``rlike``); Catalyst keeps
the order inside one Filter, so the regex only runs on candidate rows.
Date bounds are written as ranges on typed columns so they reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import multimatch
from tessera.functions import text as tx
from tessera.schemas import AI_KEYWORDS, AI_STEMS, REPUTABLE_SOURCES, SHORT_EXACT


def year_between(date_str: Column, lo: int, hi: int) -> Column:
    """``lo <= int(date[:4]) <= hi`` on an ISO date string; null if the year
    does not parse."""
    y = F.substring(date_str, 1, 4).try_cast("int")
    return (y >= lo) & (y <= hi)


def date_text_between(date_str: Column, lo: int, hi: int) -> Column:
    """The same bounds on the text itself, for four-digit years: it lies
    between them whenever its year does, and the scan can push them down."""
    if not 1000 <= lo <= hi <= 9998:
        raise ValueError("years must have four digits")
    return (date_str >= str(lo)) & (date_str < str(hi + 1))


def source_in(source: Column, allowed: list[str]) -> Column:
    """Case-insensitive membership in a fixed list (an ``In`` set lookup)."""
    return F.lower(source).isin([s.lower() for s in allowed])


def relevance(text: Column, date_str: Column, source: Column, *,
              keywords: list[str] = AI_KEYWORDS, sources: list[str] = REPUTABLE_SOURCES,
              years: tuple[int, int] = (2020, 2025), min_tokens: int = 500,
              min_occurrences: int = 6, min_distinct: int = 3) -> Column:
    """News relevance: all inputs present, year in range, more than
    ``min_tokens`` single-space tokens, keyword occurrences above
    ``min_occurrences`` or distinct keywords above ``min_distinct``, and an
    accepted source.  Both keyword counts compare lower-cased keywords with
    lower-cased text."""
    present = text.isNotNull() & date_str.isNotNull() & source.isNotNull()
    uniq = list(dict.fromkeys(k.lower() for k in keywords))

    def keyword_test(low: Column) -> Column:  # the lower-cased text, computed once
        occ = sum((tx.occurrences(low, k.lower()) for k in keywords), F.lit(0))
        distinct = sum((low.contains(k).cast("int") for k in uniq), F.lit(0))
        return (occ > min_occurrences) | (distinct > min_distinct)

    return (present
            & date_text_between(date_str, *years) & year_between(date_str, *years)
            & source_in(source, sources)
            & (tx.space_token_count(text) > min_tokens)
            & tx.let(F.lower(text), keyword_test))


def stem_filter(df: DataFrame, title: str, body: str, *, stems: list[str] = AI_STEMS,
                exact: list[str] = SHORT_EXACT, min_hits: int = 3, out: str = "hits", one_pass: bool = False) -> DataFrame:
    """Rows with at least ``min_hits`` distinct stems in ``title + " " + body``,
    with their number in ``out`` (counted once per row).  ``one_pass`` reads
    each text once for all stems, which pays for long lists."""
    t = F.concat(F.coalesce(F.col(title).cast("string"), F.lit("None")), F.lit(" "),
                 F.coalesce(F.col(body).cast("string"), F.lit("None")))
    if one_pass:
        scored = df.withColumn(out, multimatch.hits_once(t, stems, exact))
    else:
        scored = tx.compute_once(df, **{out: tx.stem_hits(t, stems, exact)})
    return scored.where(F.col(out) >= min_hits)


def parse_ts(c: Column, fmt: str | None = None) -> Column:
    """Timestamp parse that yields null for text that does not parse."""
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)


def drop_bad_dates(df: DataFrame, col: str, out: str | None = None,
                   fmt: str | None = None) -> DataFrame:
    """Parse ``col`` (null on garbage) and drop rows that did not parse."""
    out = out or col
    return df.withColumn(out, parse_ts(F.col(col), fmt)).where(F.col(out).isNotNull())


def like_then_regex(text: Column, word: str) -> Column:
    """Cheap lower-case substring test, then the word-boundary regex."""
    low = F.lower(text)
    return low.contains(word.lower()) & low.rlike(tx.word_regex(word.lower()))


def null_safe_not_equal(c: Column, value) -> Column:
    """``c != value`` where null counts as different (kept)."""
    return ~c.eqNullSafe(F.lit(value))


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (left semi join); the planner broadcasts
    the keys when their size in bytes allows it."""
    cols = [on] if isinstance(on, str) else on
    return df.join(keys.select(*cols).distinct(), on=cols, how="left_semi")


def funnel(df: DataFrame, pred: Column) -> DataFrame:
    """Before / kept / removed counts of a filter in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(pred).alias("kept")) \
             .select("total", "kept", (F.col("total") - F.col("kept")).alias("removed"))

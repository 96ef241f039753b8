"""Registered filter and predicate queries.

The original keyword and source lists never occur in the invented prose
of the test corpus, so these queries pass lists of words that do occur
(``PROBE_*``); the operators default to the original lists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import filters as fl
from tessera.plans import sqlbits as S
from tessera.plans.registry import ORACLE, register
from tessera.sources.tables import POSTS_SQL, posts, with_ctes

_P = with_ctes(POSTS_SQL)

# Parameters for the test corpus (words that occur in it; one capitalised
# keyword and source check that matching is case-insensitive).
PROBE_KEYWORDS = ["that", "With", "this", "from", " ai ", "of the", "pour", "und", "los"]
PROBE_SOURCES = ["SRC0", "src1", "src2", "src3", "src5", "src8", "src13"]
PROBE_STEMS = ["that", "with", "this", "from", "pour", "und", "los", "ai", "is", "tion"]
PROBE_EXACT = ["ai", "is"]


def _src_list() -> str:
    return "(" + ", ".join(S.q(s.lower()) for s in PROBE_SOURCES) + ")"


_YEAR = "TRY_CAST(substring(published_raw, 1, 4) AS INTEGER)"


@register("news_relevance_filter", _P + f"""
SELECT id FROM posts
WHERE body_text IS NOT NULL AND published_raw IS NOT NULL AND sitename IS NOT NULL
  AND {_YEAR} BETWEEN 2020 AND 2025
  AND lower(sitename) IN {_src_list()}
  AND {S.space_token_count('body_text')} > 500
  AND ({S.keyword_occurrences('body_text', PROBE_KEYWORDS)} > 6
       OR {S.keyword_distinct('body_text', PROBE_KEYWORDS)} > 3)""")
def q_news_relevance_filter(spark, sf):
    p = posts(spark, sf)
    pred = fl.relevance(F.col("body_text"), F.col("published_raw"), F.col("sitename"),
                        keywords=PROBE_KEYWORDS, sources=PROBE_SOURCES)
    return p.where(pred).select("id")


@register("keyword_occurrences", f"""
SELECT doc_id, {S.keyword_occurrences('text', PROBE_KEYWORDS)} AS occurrences FROM documents""")
def q_keyword_occurrences(spark, sf):
    from tessera.sources.tables import table
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.keyword_occurrences("text", PROBE_KEYWORDS).alias("occurrences"))


@register("keyword_distinct", f"""
SELECT doc_id, {S.keyword_distinct('text', PROBE_KEYWORDS)} AS distinct_hits FROM documents""")
def q_keyword_distinct(spark, sf):
    from tessera.sources.tables import table
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.keyword_distinct("text", PROBE_KEYWORDS).alias("distinct_hits"))


@register("source_in_list", _P + f"""
SELECT id, sitename FROM posts WHERE lower(sitename) IN {_src_list()}""")
def q_source_in_list(spark, sf):
    p = posts(spark, sf)
    return p.where(fl.source_in(F.col("sitename"), PROBE_SOURCES)).select("id", "sitename")


_STEM_TEXT = "(coalesce(title, 'None') || ' ' || coalesce(body_text, 'None'))"


@register("keyword_stem_filter", _P + f"""
SELECT id, {S.stem_hits(_STEM_TEXT, PROBE_STEMS, PROBE_EXACT)} AS hits FROM posts
WHERE {S.stem_hits(_STEM_TEXT, PROBE_STEMS, PROBE_EXACT)} >= 3""")
def q_keyword_stem_filter(spark, sf):
    p = posts(spark, sf)
    kept = fl.stem_filter(p.select("id", "title", "body_text"), "title", "body_text", stems=PROBE_STEMS,
                          exact=PROBE_EXACT)
    return kept.select("id", "hits")


@register("keyword_stem_onepass", ORACLE["keyword_stem_filter"])
def q_keyword_stem_onepass(spark, sf):
    """The stem filter by one automaton for all stems."""
    p = posts(spark, sf)
    kept = fl.stem_filter(p.select("id", "title", "body_text"), "title", "body_text", stems=PROBE_STEMS,
                          exact=PROBE_EXACT, one_pass=True)
    return kept.select("id", "hits")


@register("drop_bad_dates", _P + """
SELECT id, try_strptime(published_raw, '%Y-%m-%d %H:%M:%S') AS published_at FROM posts
WHERE try_strptime(published_raw, '%Y-%m-%d %H:%M:%S') IS NOT NULL""")
def q_drop_bad_dates(spark, sf):
    p = posts(spark, sf).select("id", "published_raw")
    return fl.drop_bad_dates(p, "published_raw", "published_at").select("id", "published_at")


@register("date_floor", _P + """
SELECT count(*) AS total, count(*) FILTER (WHERE published_at >= TIMESTAMP '2021-06-30') AS kept,
  count(*) - count(*) FILTER (WHERE published_at >= TIMESTAMP '2021-06-30') AS removed
FROM posts""")
def q_date_floor(spark, sf):
    p = posts(spark, sf)
    return fl.funnel(p, F.col("published_at") >= F.lit("2021-06-30").cast("timestamp"))


@register("like_then_regex", _P + f"""
SELECT id, published_at FROM posts
WHERE published_at >= TIMESTAMP '2025-01-01' AND published_at < TIMESTAMP '2026-01-01'
  AND contains(lower(body_text), 'that') AND {S.word_match('lower(body_text)', 'that')}""")
def q_like_then_regex(spark, sf):
    p = posts(spark, sf)
    yr = (F.col("published_at") >= F.lit("2025-01-01").cast("timestamp")) & \
         (F.col("published_at") < F.lit("2026-01-01").cast("timestamp"))
    return p.where(yr & fl.like_then_regex(F.col("body_text"), "that")).select("id", "published_at")


@register("null_safe_not_equal", _P + """
SELECT id, primary_label FROM posts WHERE primary_label IS DISTINCT FROM 'TECHNICAL'""")
def q_null_safe_not_equal(spark, sf):
    p = posts(spark, sf)
    return p.where(fl.null_safe_not_equal(F.col("primary_label"), "TECHNICAL")).select(
        "id", "primary_label")


@register("high_confidence", _P + """
SELECT id, primary_score, secondary_score FROM posts WHERE secondary_score > 0 AND primary_score > 0.7""")
def q_high_confidence(spark, sf):
    p = posts(spark, sf)
    return p.where((F.col("secondary_score") > 0) & (F.col("primary_score") > 0.7)).select(
        "id", "primary_score", "secondary_score")


@register("filter_funnel", _P + f"""
SELECT count(*) AS total,
  count(*) FILTER (WHERE lower(sitename) IN {_src_list()}
    AND {S.space_token_count('body_text')} > 500) AS kept,
  count(*) - count(*) FILTER (WHERE lower(sitename) IN {_src_list()}
    AND {S.space_token_count('body_text')} > 500) AS removed
FROM posts""")
def q_filter_funnel(spark, sf):
    p = posts(spark, sf)
    pred = fl.source_in(F.col("sitename"), PROBE_SOURCES) & (tx.space_token_count("body_text") > 500)
    return fl.funnel(p, pred)


@register("scan_projected_notnull", _P + """
SELECT id, url, title FROM posts WHERE url IS NOT NULL""")
def q_scan_projected_notnull(spark, sf):
    return posts(spark, sf).where(F.col("url").isNotNull()).select("id", "url", "title")

"""Registered profiling queries (lengths, summaries, histograms, nulls, time)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import profile as pf
from tessera.operators import topk
from tessera.plans import sqlbits as S
from tessera.plans.registry import register
from tessera.sources.tables import POSTS_SQL, posts, table, with_ctes

_P = with_ctes(POSTS_SQL)

# Concept regexes for the test corpus (the original concepts never occur in
# its invented prose); same shape as the original: word-bounded alternatives.
PROBE_CONCEPTS = {
    "the": r"\bthe\b",
    "that_or_this": r"\bthat\b|\bthis\b",
    "with_or_pour": r"\bwith\b|\bpour\w*\b",
    "und": r"\bund\b|\bund der\b",
}


def _r6(cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("avg_words_by_year", _P + f"""
SELECT CAST(year(published_at) AS INTEGER) AS year_released,
  round(avg({S.word_count('body_text')}), 6) AS avg_words
FROM posts WHERE published_at IS NOT NULL AND body_text IS NOT NULL GROUP BY 1""")
def q_avg_words_by_year(spark, sf):
    r = pf.word_stats_by_year(posts(spark, sf), "published_at", "body_text")
    return r.select("year_released", F.round("avg_words", 6).alias("avg_words"))


@register("concept_mentions_by_year", _P + "SELECT CAST(year(published_at) AS INTEGER) AS year_released, "
          + ", ".join(f"count(*) FILTER (WHERE {S.regex_match('lower(body_text)', p)}) AS {n}"
                      for n, p in PROBE_CONCEPTS.items())
          + " FROM posts WHERE published_at IS NOT NULL AND body_text IS NOT NULL GROUP BY 1")
def q_concept_mentions_by_year(spark, sf):
    return pf.concept_mentions(posts(spark, sf), "published_at", "body_text", PROBE_CONCEPTS)


_SUMMARY_SQL = """
SELECT count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
  min(v) AS min, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25,
  round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
  round(quantile_cont(v, 0.9), 6) AS p90, max(v) AS max
FROM ({src})"""


def _summary(df):
    s = pf.summary(df, F.col("v"))
    return s.select("count", *_r6(["mean", "std"]), "min", *_r6(["p10", "p25", "p50", "p75", "p90"]),
                    "max")


@register("word_count_summary", _P + _SUMMARY_SQL.format(
    src=f"SELECT CAST({S.word_count('body_text')} AS DOUBLE) AS v FROM posts WHERE body_text IS NOT NULL"))
def q_word_count_summary(spark, sf):
    p = posts(spark, sf).where(F.col("body_text").isNotNull())
    return _summary(p.select(tx.word_count("body_text").alias("v")))


@register("title_length_summary", _P + _SUMMARY_SQL.format(
    src=f"SELECT CAST({S.word_count('title')} AS DOUBLE) AS v FROM posts WHERE title IS NOT NULL"))
def q_title_length_summary(spark, sf):
    p = posts(spark, sf).where(F.col("title").isNotNull())
    return _summary(p.select(tx.word_count("title").alias("v")))


@register("word_count_iqr", _P + f"""
SELECT round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr
FROM (SELECT CAST({S.word_count('body_text')} AS DOUBLE) AS v FROM posts WHERE body_text IS NOT NULL)""")
def q_word_count_iqr(spark, sf):
    p = posts(spark, sf).where(F.col("body_text").isNotNull())
    return pf.iqr(p, tx.word_count("body_text")).select(F.round("iqr", 6).alias("iqr"))


@register("date_range", _P + """
SELECT min(published_at) AS first, max(published_at) AS last FROM posts""")
def q_date_range(spark, sf):
    return pf.date_range(posts(spark, sf), "published_at")


_NULL_COLS = ["title", "url", "pos_score", "neg_score", "primary_label", "published_raw"]


@register("null_profile", _P + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100.0 AS percent FROM posts"
    for c in _NULL_COLS) + ")")
def q_null_profile(spark, sf):
    return pf.null_profile(posts(spark, sf), _NULL_COLS)


@register("null_matrix", _P + "SELECT id, " + ", ".join(
    f"{c} IS NULL AS {c}_null" for c in _NULL_COLS) + " FROM posts ORDER BY id LIMIT 100")
def q_null_matrix(spark, sf):
    return pf.null_matrix(posts(spark, sf), ["id"], 100, _NULL_COLS)


@register("histogram_word_count", f"""
WITH v AS (SELECT CAST({S.word_count('text')} AS DOUBLE) AS v FROM documents),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
c AS (SELECT CAST(least(floor((v - lo) * 40.0 / (hi - lo)), 39) AS INTEGER) AS bin, count(*) AS n
      FROM v, b GROUP BY 1),
e AS (SELECT CAST(range AS INTEGER) AS bin FROM range(40))
SELECT e.bin, lo + e.bin * ((hi - lo) / 40) AS lo, lo + (e.bin + 1) * ((hi - lo) / 40) AS hi,
  coalesce(c.n, 0) AS n
FROM e CROSS JOIN b LEFT JOIN c ON c.bin = e.bin""")
def q_histogram_word_count(spark, sf):
    d = table(spark, sf, "documents")
    return pf.histogram(d, tx.word_count("text"), 40)


@register("articles_per_month", _P + """
SELECT substring(published_raw, 1, 7) AS month, count(*) AS n FROM posts GROUP BY 1""")
def q_articles_per_month(spark, sf):
    p = posts(spark, sf)
    return p.groupBy(F.substring("published_raw", 1, 7).alias("month")).agg(
        F.count(F.lit(1)).alias("n"))


@register("posts_per_week", _P + """
, c AS (SELECT CAST(date_trunc('week', published_at) AS DATE) + 6 AS week, count(*) AS n
        FROM posts WHERE published_at IS NOT NULL GROUP BY 1),
w AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM c)
SELECT w.week, coalesce(c.n, 0) AS n FROM w LEFT JOIN c ON c.week = w.week""")
def q_posts_per_week(spark, sf):
    return pf.weekly_counts(posts(spark, sf), "published_at")


@register("duplicate_profile", """
SELECT count(*) AS rows, count(DISTINCT text) AS distinct_keys,
  count(*) - count(DISTINCT text) AS duplicates FROM documents""")
def q_duplicate_profile(spark, sf):
    return pf.duplicate_profile(table(spark, sf, "documents"), "text")


_TAGS = """, tags AS (
  SELECT CAST(year(published_at) AS INTEGER) AS year_released, trim(t) AS tag
  FROM posts, unnest(string_split(tags, ',')) AS u(t)
  WHERE published_at IS NOT NULL AND tags IS NOT NULL AND trim(t) <> ''),
top AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 8)
"""


@register("top_tags", _P + _TAGS + "SELECT tag, n FROM top")
def q_top_tags(spark, sf):
    return topk.top_counts(_tag_rows(spark, sf), "tag", 8)


@register("top_tag_semi_join", _P + _TAGS + """
SELECT year_released, tag FROM tags WHERE tag IN (SELECT tag FROM top)""")
def q_top_tag_semi_join(spark, sf):
    rows = _tag_rows(spark, sf)
    return topk.semi_join_top(rows, "tag", 8).select("year_released", "tag")


@register("tag_counts_by_year", _P + _TAGS + """
, f AS (SELECT * FROM tags WHERE tag IN (SELECT tag FROM top)),
y AS (SELECT DISTINCT year_released FROM f),
c AS (SELECT year_released, tag, count(*) AS n FROM f GROUP BY 1, 2)
SELECT y.year_released, top.tag, coalesce(c.n, 0) AS n
FROM y CROSS JOIN top LEFT JOIN c ON c.year_released = y.year_released AND c.tag = top.tag""")
def q_tag_counts_by_year(spark, sf):
    return topk.counts_by_top(_tag_rows(spark, sf), "year_released", "tag", 8)


def _tag_rows(spark, sf):
    p = posts(spark, sf).where(F.col("published_at").isNotNull() & F.col("tags").isNotNull())
    return p.select(F.year("published_at").alias("year_released"),
                    F.explode(tx.split_tags("tags")).alias("tag"))


#: Columns of the wide form and the tags they count.
WIDE_TAGS = {"en": "en", "de": "de", "fr": "fr", "es": "es", "topic_0": "topic0", "topic_1": "topic1",
             "source_0": "src0", "source_1": "src1"}


@register("tag_counts_by_year_wide", _P + _TAGS + "SELECT year_released, " + ", ".join(
    f"count(*) FILTER (WHERE tag = '{v}') AS {n}" for n, v in WIDE_TAGS.items()) + " FROM tags GROUP BY year_released")
def q_tag_counts_by_year_wide(spark, sf):
    """One column per wanted tag."""
    return topk.counts_by_values(_tag_rows(spark, sf), "year_released", "tag", WIDE_TAGS)


@register("events_per_week", """
WITH c AS (SELECT CAST(date_trunc('week', ts) AS DATE) + 6 AS week, count(*) AS n
           FROM events WHERE ts IS NOT NULL GROUP BY 1),
w AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM c)
SELECT w.week, coalesce(c.n, 0) AS n FROM w LEFT JOIN c ON c.week = w.week""")
def q_events_per_week(spark, sf):
    """Weekly counts on a ``timestamp_ntz`` column (weeks ending Sunday)."""
    return pf.weekly_counts(table(spark, sf, "events"), "ts")

"""Registered dashboard queries (trends) over the ``posts`` stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import trends
from tessera.plans.registry import register
from tessera.schemas import SECONDARY_LABEL_PATTERNS
from tessera.sources.tables import POSTS_SQL, posts, with_ctes

_P = with_ctes(POSTS_SQL)


def _sql_pct(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) * 100.0::DOUBLE / count(*)"


@register("sentiment_by_month", _P + f"""
SELECT strftime(date_trunc('month', published_on), '%Y-%m') AS month_released,
  {_sql_pct('pos_score - neg_score > 0.0')} AS positive,
  {_sql_pct('pos_score - neg_score < -0.0')} AS negative,
  100.0::DOUBLE - {_sql_pct('pos_score - neg_score > 0.0')}
    - {_sql_pct('pos_score - neg_score < -0.0')} AS neutral
FROM posts
WHERE published_on >= DATE '2021-01-01' AND published_on < DATE '2026-01-01'
GROUP BY date_trunc('month', published_on)
HAVING count(*) > 5
""")
def q_sentiment_by_month(spark, sf):
    return trends.sentiment_by_month(posts(spark, sf), "published_on", "pos_score", "neg_score",
                                     threshold=0.0, min_posts=5)


@register("sentiment_by_month_both", _P + f"""
SELECT corpus, strftime(date_trunc('month', published_on), '%Y-%m') AS month_released,
  {_sql_pct('pos_score - neg_score > 0.1')} AS positive,
  {_sql_pct('pos_score - neg_score < -0.1')} AS negative,
  100.0::DOUBLE - {_sql_pct('pos_score - neg_score > 0.1')}
    - {_sql_pct('pos_score - neg_score < -0.1')} AS neutral
FROM posts
WHERE published_on >= DATE '2021-01-01' AND published_on < DATE '2026-01-01'
GROUP BY corpus, date_trunc('month', published_on)
HAVING count(*) > 3
""")
def q_sentiment_by_month_both(spark, sf):
    p = posts(spark, sf)
    frames = {"news": p.where(F.col("corpus") == "news"), "dev": p.where(F.col("corpus") == "dev")}
    return trends.sentiment_by_month_both(frames, {"news": "published_on", "dev": "published_on"},
                                          "pos_score", "neg_score", threshold=0.1, min_posts=3)


@register("sentiment_by_topic", _P + """
SELECT dominant_topic,
  count(*) FILTER (WHERE pos_score - neg_score >= 0) * 100.0::DOUBLE / count(*) AS positive,
  count(*) FILTER (WHERE pos_score - neg_score <= 0) * 100.0::DOUBLE / count(*) AS negative
FROM posts WHERE dominant_topic != -1
GROUP BY dominant_topic
""")
def q_sentiment_by_topic(spark, sf):
    return trends.sentiment_by_topic(posts(spark, sf), "dominant_topic", "pos_score", "neg_score",
                                     topic=-1)


@register("sentiment_by_one_topic", _P + """
SELECT dominant_topic,
  count(*) FILTER (WHERE pos_score - neg_score >= 0) * 100.0::DOUBLE / count(*) AS positive,
  count(*) FILTER (WHERE pos_score - neg_score <= 0) * 100.0::DOUBLE / count(*) AS negative
FROM posts WHERE dominant_topic = 3
GROUP BY dominant_topic
""")
def q_sentiment_by_one_topic(spark, sf):
    return trends.sentiment_by_topic(posts(spark, sf), "dominant_topic", "pos_score", "neg_score",
                                     topic=3)


@register("sentiment_all_topics", _P + """
, t AS (
  SELECT dominant_topic,
    count(*) FILTER (WHERE pos_score - neg_score >= 0) * 100.0::DOUBLE / count(*) AS positive,
    count(*) FILTER (WHERE pos_score - neg_score <= 0) * 100.0::DOUBLE / count(*) AS negative
  FROM posts WHERE dominant_topic != -1 GROUP BY dominant_topic
), s AS (SELECT sum(positive) AS positive, sum(negative) AS negative FROM t)
SELECT round(positive, 6) AS positive, round(negative, 6) AS negative,
  round(positive * 100.0 / (positive + negative), 6) AS positive_share,
  round(negative * 100.0 / (positive + negative), 6) AS negative_share
FROM s
""")
def q_sentiment_all_topics(spark, sf):
    per = trends.sentiment_by_topic(posts(spark, sf), "dominant_topic", "pos_score", "neg_score")
    out = trends.sentiment_all_topics(per)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@register("topic_share_by_month", _P + "SELECT strftime(date_trunc('month', published_on), '%Y-%m')"
          " AS month_released, " + ", ".join(
              f"count(*) FILTER (WHERE dominant_topic = {i}) * 100.0::DOUBLE / count(*) AS topic_{i}"
              for i in range(8)) + """
FROM posts WHERE published_on IS NOT NULL
GROUP BY date_trunc('month', published_on) HAVING count(*) > 5
""")
def q_topic_share_by_month(spark, sf):
    return trends.topic_share_by_month(posts(spark, sf), "published_on", "dominant_topic",
                                       n_topics=8, min_posts=5)


@register("secondary_label_by_month", _P + "SELECT strftime(date_trunc('month', published_on), '%Y-%m')"
          " AS month_released, " + ", ".join(
              "count(*) FILTER (WHERE secondary_label ILIKE '" + p.replace("'", "''") +
              f"') * 100.0::DOUBLE / count(*) AS topic_{i}"
              for i, p in enumerate(SECONDARY_LABEL_PATTERNS)) + """
FROM posts WHERE published_on IS NOT NULL
GROUP BY date_trunc('month', published_on) HAVING count(*) > 12
""")
def q_secondary_label_by_month(spark, sf):
    return trends.label_share_by_month(posts(spark, sf), "published_on", "secondary_label",
                                       SECONDARY_LABEL_PATTERNS, min_posts=12)


@register("secondary_label_subset", _P + "SELECT strftime(date_trunc('month', published_on), '%Y-%m')"
          " AS month_released, " + ", ".join(
              "count(*) FILTER (WHERE secondary_label ILIKE '" + p.replace("'", "''") +
              f"') * 100.0::DOUBLE / count(*) AS topic_{i}"
              for i, p in enumerate(SECONDARY_LABEL_PATTERNS) if i in (1, 4)) + """
FROM posts WHERE published_on IS NOT NULL
GROUP BY date_trunc('month', published_on) HAVING count(*) > 12
""")
def q_secondary_label_subset(spark, sf):
    flags = [i in (1, 4) for i in range(len(SECONDARY_LABEL_PATTERNS))]
    return trends.label_share_by_month(posts(spark, sf), "published_on", "secondary_label",
                                       SECONDARY_LABEL_PATTERNS, min_posts=12, included=flags)


@register("posts_per_year", _P + """
SELECT CAST(year(published_at) AS INTEGER) AS year_released, count(*) AS n
FROM posts GROUP BY 1
""")
def q_posts_per_year(spark, sf):
    return trends.counts_by(posts(spark, sf), F.year("published_at"), "year_released")


@register("posts_per_month_of_year", _P + """
SELECT CAST(month(published_at) AS INTEGER) AS month_released, count(*) AS n
FROM posts GROUP BY 1
""")
def q_posts_per_month_of_year(spark, sf):
    return trends.counts_by(posts(spark, sf), F.month("published_at"), "month_released")

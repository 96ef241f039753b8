"""Joins: lookups with fallbacks, serving join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import DEV_TOPICS, DISPLAY_ORDER, NEWS_TOPICS

def topic_dim(spark: SparkSession) -> DataFrame:
    """(corpus, topic_id, keywords, display_no): topic names by id for both
    corpora; ``display_no`` is the 1-based place in which the topic is shown."""
    rows = [(c, i, kw, DISPLAY_ORDER.index(i) + 1) for c, names in (("news", NEWS_TOPICS), ("dev", DEV_TOPICS))
            for i, kw in enumerate(names)]
    return spark.createDataFrame(rows, "corpus string, topic_id int, keywords string, display_no int")


def topic_name(df: DataFrame, corpus_col: str, topic_col: str, out: str = "topic_name",
               display: str | None = None) -> DataFrame:
    """Attach the topic keywords; ids without a name (out of range, null) keep
    their id as text.  ``display`` names a column for the place in which the
    topic is shown (null without a name)."""
    dim = F.broadcast(topic_dim(df.sparkSession))  # 16 rows by construction
    j = df.join(dim, (df[corpus_col] == dim["corpus"]) & (df[topic_col] == dim["topic_id"]), "left")
    return j.select(*[df[c] for c in df.columns],
                    F.coalesce(dim["keywords"], df[topic_col].cast("string")).alias(out),
                    *([dim["display_no"].alias(display)] if display else []))


def backfill(df: DataFrame, side: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join model output onto rows by key, filling missing values."""
    j = df.join(side, key, "left")
    return j.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else c
                      for c in j.columns])


def serving_join(enriched: DataFrame, raw: DataFrame, key: str, enriched_cols: list[str],
                 raw_cols: list[str], pos_col: str, neg_col: str) -> DataFrame:
    """Inner join of enrichment columns with raw rows (rows of other sources
    drop out) plus the net score ``pos - neg``.  Only the named columns
    enter the join, so wide text stays on one side."""
    e = enriched.select(key, *enriched_cols)
    r = raw.select(key, *raw_cols)
    j = r.join(e, key, "inner")
    return j.withColumn("roberta_score", F.col(pos_col) - F.col(neg_col))

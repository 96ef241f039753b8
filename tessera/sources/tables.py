"""Driver tables and the stand-in views derived from them.

The driver tables (``documents``, ``embeddings``, ``labels`` ...) have no
titles, dates, topics or model scores.  ``posts`` derives those columns
deterministically from every row of ``documents`` (nothing is filtered), so
every query over ``posts`` reads the whole table and grows with it.  Each
derivation has a DuckDB twin (``*_SQL``) that the oracle inlines as a CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import SECONDARY_LABELS, UNSURE

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the name is checked against the allow-list."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SECONDARY = SECONDARY_LABELS + [UNSURE]


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    doc_id, n_chars = F.col("doc_id"), F.col("n_chars")
    published_on = F.date_add(F.lit("2020-01-01").cast("date"), ((doc_id * 37) % 2190).cast("int"))
    published_at = F.timestamp_seconds(F.unix_date(published_on).cast("bigint") * 86400
                                       + (doc_id * 3607) % 86400)
    scored = doc_id % 10 != 0
    sec = F.element_at(F.array(*[F.lit(s) for s in _SECONDARY]), (n_chars % 8 + 1).cast("int"))
    return d.select(
        doc_id.alias("id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("body_text"),
        F.col("source").alias("sitename"),
        "lang",
        "n_chars",
        F.when(doc_id % 2 == 0, "news").otherwise("dev").alias("corpus"),
        published_on.alias("published_on"),
        published_at.alias("published_at"),
        F.when(doc_id % 17 == 0, F.lit("unknown"))
         .otherwise(F.date_format(published_at, "yyyy-MM-dd HH:mm:ss")).alias("published_raw"),
        ((doc_id * 5 + n_chars) % 8).cast("int").alias("dominant_topic"),
        F.when(scored, (n_chars % 101).cast("double") / 100).alias("pos_score"),
        F.when(scored, ((doc_id * 13) % 101).cast("double") / 100).alias("neg_score"),
        sec.alias("secondary_label"),
        F.when(sec == UNSURE, F.lit(0.0))
         .otherwise(((doc_id * 3) % 101).cast("double") / 100).alias("secondary_score"),
        F.when((doc_id * 7) % 3 == 0, "TECHNICAL").when((doc_id * 7) % 3 == 1, "NON_TECHNICAL")
         .alias("primary_label"),
        (((doc_id * 11) % 101).cast("double") / 100).alias("primary_score"),
        F.when(doc_id % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("https://example.com/p/"), doc_id.cast("string"))).alias("url"),
        F.concat(F.lit("post-"), doc_id.cast("string")).alias("slug"),
        F.concat_ws(", ", "lang", "source", F.concat(F.lit("topic"), (n_chars % 5).cast("string")))
         .alias("tags"),
    )


POSTS_SQL = f"""posts AS (
  SELECT doc_id AS id,
    split_part(text, chr(10), 1) AS title,
    text AS body_text,
    source AS sitename,
    lang,
    n_chars,
    CASE WHEN doc_id % 2 = 0 THEN 'news' ELSE 'dev' END AS corpus,
    CAST(DATE '2020-01-01' + CAST((doc_id * 37) % 2190 AS INTEGER) AS DATE) AS published_on,
    CAST(DATE '2020-01-01' + CAST((doc_id * 37) % 2190 AS INTEGER) AS TIMESTAMP)
      + to_seconds((doc_id * 3607) % 86400) AS published_at,
    CASE WHEN doc_id % 17 = 0 THEN 'unknown'
      ELSE strftime(CAST(DATE '2020-01-01' + CAST((doc_id * 37) % 2190 AS INTEGER) AS TIMESTAMP)
        + to_seconds((doc_id * 3607) % 86400), '%Y-%m-%d %H:%M:%S') END AS published_raw,
    CAST((doc_id * 5 + n_chars) % 8 AS INTEGER) AS dominant_topic,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(n_chars % 101 AS DOUBLE) / 100 END AS pos_score,
    CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST((doc_id * 13) % 101 AS DOUBLE) / 100 END AS neg_score,
    {_sql_list(_SECONDARY)}[CAST(n_chars % 8 AS INTEGER) + 1] AS secondary_label,
    CASE WHEN n_chars % 8 = 7 THEN 0.0::DOUBLE
      ELSE CAST((doc_id * 3) % 101 AS DOUBLE) / 100 END AS secondary_score,
    CASE WHEN (doc_id * 7) % 3 = 0 THEN 'TECHNICAL' WHEN (doc_id * 7) % 3 = 1 THEN 'NON_TECHNICAL'
      END AS primary_label,
    CAST((doc_id * 11) % 101 AS DOUBLE) / 100 AS primary_score,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'https://example.com/p/' || CAST(doc_id AS VARCHAR) END AS url,
    'post-' || CAST(doc_id AS VARCHAR) AS slug,
    concat_ws(', ', lang, source, 'topic' || CAST(n_chars % 5 AS VARCHAR)) AS tags
  FROM documents
)"""


def scorer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scorers' labels per post: two rule stand-ins and one from ``labels``
    (null where a document is unlabelled)."""
    names = F.array(F.lit("positive"), F.lit("neutral"), F.lit("negative"))
    p = posts(spark, sf_dir).select("id", "n_chars", "corpus", "dominant_topic")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    return p.join(lab, "id", "left").select(
        "id", "corpus", "dominant_topic",
        F.element_at(names, (F.col("n_chars") % 3 + 1).cast("int")).alias("vader_sentiment"),
        F.element_at(names, ((F.col("id") * 7) % 3 + 1).cast("int")).alias("tb_sentiment"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("toxic") == 0, "positive")
         .alias("roberta_label"),
    )


SCORERS_SQL = """scorers AS (
  SELECT p.id, p.corpus, p.dominant_topic,
    ['positive', 'neutral', 'negative'][CAST(p.n_chars % 3 AS INTEGER) + 1] AS vader_sentiment,
    ['positive', 'neutral', 'negative'][CAST((p.id * 7) % 3 AS INTEGER) + 1] AS tb_sentiment,
    CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.toxic = 0 THEN 'positive' END AS roberta_label
  FROM posts p LEFT JOIN labels l ON l.doc_id = p.id
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"

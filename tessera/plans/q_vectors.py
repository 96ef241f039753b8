"""Registered vector queries over ``embeddings``.

Stand-ins: ``label`` is the cluster; the two corpora are the even and odd
``vec_id`` rows (every row is in one of them); the theme vector is the
mean of all vectors (the original embeds a theme sentence).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as vf
from tessera.operators import ball_index, joins
from tessera.operators import vectors as vo
from tessera.operators.filters import keep_keys
from tessera.plans.registry import register
from tessera.schemas import DEV_TOPICS, NEWS_TOPICS
from tessera.session import checkpoint_dir, stage_path, stage_table
from tessera.sources.tables import POSTS_SQL, posts, table

THEME_THRESHOLD = 0.4
TOP_K = 3


def _emb(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.withColumn("corpus", F.when(F.col("vec_id") % 2 == 0, "news").otherwise("dev"))


_THEME_SQL = """theme AS (
  SELECT list(m ORDER BY pos) AS t FROM (
    SELECT pos, avg(CAST(v AS DOUBLE)) AS m
    FROM (SELECT unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
    GROUP BY pos))"""

_CENT_SQL = """cents AS (
  SELECT label, count(*) AS n FROM embeddings GROUP BY label),
cvec AS (
  SELECT label, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m
    FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS pos
          FROM embeddings)
    GROUP BY label, pos) GROUP BY label)"""


@register("cluster_sizes", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    return vo.cluster_sizes(table(spark, sf, "embeddings"), "label")


@register("cluster_centroids", """
SELECT label, CAST(pos - 1 AS INTEGER) AS dim, round(avg(CAST(v AS DOUBLE)), 6) AS value
FROM (SELECT label, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
GROUP BY label, pos""")
def q_cluster_centroids(spark, sf):
    c = vo.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "value")).select(
        "label", "dim", F.round("value", 6).alias("value"))


@register("cosine_similarity", f"""
WITH {_THEME_SQL}
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), t), 6) AS cosine
FROM embeddings, theme""")
def q_cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    theme = vo.mean_vector(e, "embedding")
    return e.select("vec_id", F.round(vf.cosine_to("embedding", theme), 6).alias("cosine"))


@register("theme_ranked_clusters", f"""
WITH {_THEME_SQL}, {_CENT_SQL},
s AS (SELECT cents.label, cents.n, list_cosine_similarity(c, t) AS sim
      FROM cents JOIN cvec USING (label), theme)
SELECT label, n, round(sim, 6) AS sim, CAST(row_number() OVER (ORDER BY sim DESC, label) AS INTEGER) AS rank,
  sim >= {THEME_THRESHOLD} AS selected
FROM s""")
def q_theme_ranked_clusters(spark, sf):
    e = table(spark, sf, "embeddings")
    theme = vo.mean_vector(e, "embedding")
    r = vo.rank_by_theme(vo.centroids(e, "label", "embedding"), "label", theme, THEME_THRESHOLD)
    return r.select("label", "n", F.round("sim", 6).alias("sim"), "rank", "selected")


_SELECTED_SQL = f"""
WITH {_THEME_SQL}, {_CENT_SQL},
sel AS (SELECT label FROM cvec, theme WHERE list_cosine_similarity(c, t) >= {THEME_THRESHOLD})
SELECT vec_id, label FROM embeddings WHERE label IN (SELECT label FROM sel)"""


@register("theme_filter", _SELECTED_SQL)
def q_theme_filter(spark, sf):
    e = table(spark, sf, "embeddings")
    theme = vo.mean_vector(e, "embedding")
    return vo.theme_filter(e, "label", "embedding", theme, THEME_THRESHOLD).select("vec_id", "label")


@register("cluster_semi_filter", _SELECTED_SQL.replace("SELECT vec_id, label FROM embeddings",
                                                       "SELECT vec_id, label, n_chars FROM embeddings"
                                                       " JOIN (SELECT doc_id, n_chars FROM documents) d"
                                                       " ON d.doc_id = vec_id"))
def q_cluster_semi_filter(spark, sf):
    """Documents (joined to their vector rows by id) kept when their cluster
    is selected: the semi join runs against the selected-cluster set."""
    e = table(spark, sf, "embeddings")
    theme = vo.mean_vector(e, "embedding")
    ranked = vo.rank_by_theme(vo.centroids(e, "label", "embedding"), "label", theme, THEME_THRESHOLD)
    rows = e.select("vec_id", "label").join(
        table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars"), "vec_id")
    return keep_keys(rows, ranked.where("selected"), "label").select("vec_id", "label", "n_chars")


@register("invalid_vector_guard", f"""
WITH {_THEME_SQL},
g AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(range(64), lambda i: 0.0::DOUBLE)
                          ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings)
SELECT vec_id, round((CASE WHEN list_dot_product(v, v) = 0 THEN 0.0
                           ELSE list_cosine_similarity(v, t) END + 1) / 2, 6) AS similarity
FROM g, theme""")
def q_invalid_vector_guard(spark, sf):
    e = table(spark, sf, "embeddings")
    theme = vo.mean_vector(e, "embedding")
    broken = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    sim = (vf.cosine_to(broken, theme) + 1) / 2  # wrong width -> zero vector -> 0.5
    return e.select("vec_id", F.round(sim, 6).alias("similarity"))


def _topics_sql() -> str:
    rows = [f"('{c}', {i}, '{k}')" for c, names in (("news", NEWS_TOPICS), ("dev", DEV_TOPICS))
            for i, k in enumerate(names)]
    return "topic_dim(corpus, topic_id, keywords) AS (VALUES " + ", ".join(rows) + ")"


def _topk_sql(queries_cte: str) -> str:
    return f"""
WITH {_THEME_SQL}, {_CENT_SQL}, {_topics_sql()}, {queries_cte},
corpus AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'news' ELSE 'dev' END AS corpus, label,
           CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.query_id, c.corpus, c.id, c.label, list_cosine_similarity(c.v, q.qv) AS cosine
      FROM queries q, corpus c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY cosine DESC, id) AS rank FROM s)
SELECT r.query_id, r.corpus, CAST(r.rank AS INTEGER) AS rank, r.id, round((r.cosine + 1) / 2, 6) AS similarity,
  coalesce(t.keywords, CAST(r.label AS VARCHAR)) AS topic_name
FROM r LEFT JOIN topic_dim t ON t.corpus = r.corpus AND t.topic_id = r.label
WHERE r.rank <= {TOP_K} AND (r.cosine + 1) / 2 <> 0"""


def _attach(top, e):
    named = joins.topic_name(top, "corpus", "label")  # label came with each hit
    return named.select("query_id", "corpus", "rank", "id", F.round("similarity", 6).alias("similarity"),
                        "topic_name")


@register("similarity_topk", _topk_sql("queries AS (SELECT CAST(0 AS BIGINT) AS query_id, t AS qv FROM theme)"))
def q_similarity_topk(spark, sf):
    e = _emb(spark, sf)
    theme = vo.mean_vector(e, "embedding")
    q = spark.range(1).select(F.col("id").alias("query_id"),
                              F.array(*[F.lit(x) for x in theme]).alias("embedding"))
    top = vo.similarity_topk(e, q, TOP_K, id_col="vec_id", carry=["label"])
    return _attach(top, e)


@register("similarity_topk_batch",
          _topk_sql("queries AS (SELECT CAST(label AS BIGINT) AS query_id, c AS qv FROM cvec)"))
def q_similarity_topk_batch(spark, sf):
    e = _emb(spark, sf)
    cents = vo.centroids(e, "label", "embedding").select(
        F.col("label").cast("long").alias("query_id"), F.col("centroid").alias("embedding"))
    top = vo.similarity_topk(e, cents, TOP_K, id_col="vec_id", carry=["label"])
    return _attach(top, e)


@register("similarity_pruned", _topk_sql("queries AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0)"))
def q_similarity_pruned(spark, sf):
    """Every twentieth vector against all, by an index that skips files."""
    e = _emb(spark, sf)
    index = ball_index.build(e, stage_path(spark, "balls"), "vec_id", width=64, carry=["label"])
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return _attach(ball_index.search(index, q, TOP_K)[0], e)


def _hits(spark, sf):
    """The search's hits, computed once: a few rows per query, checkpointed."""
    checkpoint_dir(spark)
    return q_similarity_topk_batch(spark, sf).checkpoint()


@register("similarity_results", _topk_sql("queries AS (SELECT CAST(label AS BIGINT) AS query_id, c AS qv FROM cvec)")
          .replace("WITH ", "WITH " + POSTS_SQL + ", ", 1)
          .replace("coalesce(t.keywords, CAST(r.label AS VARCHAR)) AS topic_name",
                   "coalesce(t.keywords, CAST(r.label AS VARCHAR)) AS topic_name, p.title, p.secondary_label")
          .replace("FROM r LEFT JOIN topic_dim t", "FROM r LEFT JOIN posts p ON p.id = r.id LEFT JOIN topic_dim t"))
def q_similarity_results(spark, sf):
    """Search hits as result records: rank, similarity and topic name plus the
    hit's title and secondary label."""
    hits = _hits(spark, sf)
    fields = keep_keys(posts(spark, sf).select("id", "title", "secondary_label"), hits, "id")
    return hits.join(fields, "id", "left").select(
        "query_id", "corpus", "rank", "id", "similarity", "topic_name", "title", "secondary_label")


def _records_sql() -> str:
    from tessera.plans import sqlbits as S
    from tessera.plans.q_labels import _LEX_SQL
    base = (_topk_sql("queries AS (SELECT CAST(label AS BIGINT) AS query_id, c AS qv FROM cvec)")
            .replace("WITH ", "WITH " + POSTS_SQL + ", " + _LEX_SQL + ", ", 1))
    polarity = """
{w}w AS (SELECT {key}, lower(unnest({words})) AS word FROM {rows}),
{w}a AS (SELECT {key}, avg(polarity) AS p, avg(subjectivity) AS q FROM {w}w JOIN lex USING (word) GROUP BY {key}),
{w}p AS (SELECT d.{key}, coalesce({w}a.p, 0.0) AS p, coalesce({w}a.q, 0.0) AS q FROM {rows} d LEFT JOIN {w}a USING ({key}))"""
    extra = """,
hits AS (SELECT DISTINCT id FROM r WHERE rank <= %d),
hd AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT id FROM hits)),
qd AS (SELECT label, 'about ' || CAST(label AS VARCHAR) || ' ' || (SELECT min(text) FROM benchmark) AS text
       FROM cvec),""" % TOP_K + polarity.format(w="h", key="doc_id", words=S.words("text"), rows="hd") + "," \
        + polarity.format(w="q", key="label", words=S.words("substring(text, 1, 1000)"), rows="qd") + """
SELECT r.query_id"""
    out = base.replace("\nSELECT r.query_id", extra, 1)
    out = out.replace("coalesce(t.keywords, CAST(r.label AS VARCHAR)) AS topic_name",
                      "coalesce(t.keywords, CAST(r.label AS VARCHAR)) AS topic_name, p.title, p.secondary_label, "
                      "hd.text AS article_text, round(hp.p, 6) AS tb_polarity, round(hp.q, 6) AS tb_subjectivity, "
                      f"CASE WHEN hp.p IS NULL THEN NULL ELSE {S.polarity_label('hp.p', 0.05, False)} END AS tb_sentiment, "
                      "round(qp.p, 6) AS query_polarity, round(qp.q, 6) AS query_subjectivity, "
                      f"{S.polarity_label('qp.p', 0.05, False)} AS query_sentiment_label")
    return out.replace("FROM r LEFT JOIN topic_dim t",
                       "FROM r LEFT JOIN posts p ON p.id = r.id LEFT JOIN hp ON hp.doc_id = r.id "
                       "LEFT JOIN hd ON hd.doc_id = r.id LEFT JOIN qp ON qp.label = r.query_id "
                       "LEFT JOIN topic_dim t")


@register("similarity_records", _records_sql())
def q_similarity_records(spark, sf):
    """Full result records: each hit with title, secondary label, text and the
    lexicon polarity, subjectivity and label of its text and of the query's.
    The scorer runs on the hit documents and the queries only."""
    from tessera.operators import labels as lb
    from tessera.plans.q_labels import lexicon
    hits = _hits(spark, sf)
    lex = lexicon(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    hit_docs = stage_table(keep_keys(docs, hits, "id"), "hits")
    pol = lb.lexicon_polarity(hit_docs, "id", "text", lex)
    first = table(spark, sf, "benchmark").agg(F.min("text").alias("t"))
    asked = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("query_id")).distinct()
    wording = first.first()["t"]  # one text
    asked = asked.select("query_id", F.concat(F.lit("about "), F.col("query_id").cast("string"), F.lit(" "),
                                              F.lit(wording)).alias("q"))
    query = lb.query_sentiment(asked, "query_id", "q", lex)
    names = keep_keys(posts(spark, sf).select("id", "title", "secondary_label"), hits, "id")
    rec = (hits.join(names, "id", "left").join(hit_docs.withColumnRenamed("text", "article_text"), "id", "left")
           .join(pol, "id", "left").join(query, "query_id", "left"))
    return rec.select("query_id", "corpus", "rank", "id", "similarity", "topic_name", "title", "secondary_label",
                      "article_text", F.round("tb_polarity", 6).alias("tb_polarity"),
                      F.round("tb_subjectivity", 6).alias("tb_subjectivity"), "tb_sentiment",
                      F.round("query_polarity", 6).alias("query_polarity"),
                      F.round("query_subjectivity", 6).alias("query_subjectivity"), "query_sentiment_label")

"""Registered model queries.

A fit has no SQL form, so most twins state what must hold of its result: every
id once, labels in range, unit vectors, probabilities that add up."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.functions import vectors as vf
from tessera.operators import models as md
from tessera.operators import topics as tp
from tessera.operators import vectors as vo
from tessera.plans.registry import register
from tessera.schemas import EMBEDDING_WIDTH
from tessera.session import stage_table
from tessera.sources.tables import POSTS_SQL, posts, table, with_ctes

# Stop words for the test corpus's invented prose (its most common short
# words across the four languages); the operators default to Spark's
# English list.
PROBE_STOP_WORDS = ["the", "and", "of", "to", "a", "in", "is", "it", "that", "with", "this", "from",
                    "are", "he", "an", "for", "on", "as", "was", "by", "be", "le", "la", "de", "der",
                    "die", "und", "en", "el", "los", "que", "et", "des", "les", "un", "une"]

_W = r"[\pL\pN\pM_]"

#: Decimals at which text similarities are compared: equal for any order of
#: summation, so that copies of a document tie.
_TEXT_DECIMALS = 9


def _docs(spark, sf):
    p = posts(spark, sf)
    return p.select("id", tx.combined_text("title", "body_text", None).alias("combined_text"))


def _shape(vec):
    """Width, and length rounded: 1, or 0 for a text without terms."""
    return F.size(vec).alias("width"), F.round(vf.l2norm(vec), 6).alias("norm")


@register("embed_tfidf", with_ctes(POSTS_SQL) + f"""
SELECT id, 384 AS width, CASE WHEN regexp_matches(body_text, '{_W}{{2,}}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM posts""")
def q_embed_tfidf(spark, sf):
    """Width and norm of every post's TF-IDF vector."""
    return md.embed_tfidf(_docs(spark, sf), "combined_text").select("id", *_shape(F.col("embedding")))


@register("embed_batches", """
SELECT doc_id, 384 AS width, CASE WHEN strlen(text) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
FROM documents""")
def q_embed_batches(spark, sf):
    """Width and norm of every document's vector from the caller's encoder."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return md.embed_batches(d, "text", md.hashing_encoder(), 384, batch_size=64).select(
        "doc_id", F.size("embedding").alias("width"), F.round(vf.l2norm("embedding"), 4).alias("norm"))


@register("kmeans_clusters", "SELECT vec_id, true AS in_range, 10 AS n_clusters FROM embeddings")
def q_kmeans_clusters(spark, sf):
    """Every vector in one of ten clusters, all of which are used."""
    e = table(spark, sf, "embeddings")
    c = stage_table(md.pca_kmeans(e, "embedding", "vec_id", width=64, k=10, dims=50), "clusters")
    used = c.agg(F.count_distinct("cluster").cast("int").alias("n_clusters")).first()[0]
    return c.select("vec_id", F.col("cluster").between(0, 9).alias("in_range"), F.lit(used).alias("n_clusters"))


@register("kmeans_minibatch", "SELECT vec_id, true AS nearest, 10 AS n_clusters FROM embeddings")
def q_kmeans_minibatch(spark, sf):
    """Mini-batch k-means: every vector's cluster is that of its nearest
    centre, by distances computed apart, and all ten are used."""
    clusters, centres, _ = md.pca_minibatch(table(spark, sf, "embeddings"), "embedding", "vec_id", width=64)
    c = stage_table(clusters, "minibatch")
    distances = F.array(*[F.aggregate(F.zip_with("reduced", F.array(*[F.lit(float(x)) for x in row]), lambda a, b: (a - b) * (a - b)),
                                      F.lit(0.0), lambda s, d: s + d) for row in centres])
    used = c.agg(F.count_distinct("cluster").cast("int").alias("n")).first()["n"]
    own = F.get(F.col("d"), F.col("cluster"))
    return c.withColumn("d", distances).select("vec_id", (own <= F.array_min("d") + 1e-9).alias("nearest"), F.lit(used).alias("n_clusters"))


def _stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in PROBE_STOP_WORDS) + "]"


@register("vocabulary_df", f"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_W}{{2,}}')) AS term FROM documents),
g AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t
      WHERE NOT list_contains({_stop_sql()}, term) GROUP BY term)
SELECT term, n, docs FROM g
WHERE docs >= 3 AND docs <= 0.5 * (SELECT count(*) FROM documents)
ORDER BY n DESC, term LIMIT 500""")
def q_vocabulary_df(spark, sf):
    d = table(spark, sf, "documents")
    return md.vocabulary(d, "doc_id", "text", PROBE_STOP_WORDS, 500, 3, 0.5)


def _topics(spark, sf):
    return tp.fit_topics(_docs(spark, sf), "id", "combined_text", k=8, max_iter=100, seed=42, stop_words=PROBE_STOP_WORDS)


@register("lda_dominant_topic", with_ctes(POSTS_SQL) + "SELECT id, true AS in_range, true AS is_likely, true AS bound_rises FROM posts")
def q_lda_dominant_topic(spark, sf):
    """Every post has a topic in range, at least as likely as the uniform one;
    no iteration of the fit lowers the bound."""
    model = _topics(spark, sf)
    rises = all(b > a - 1e-9 for a, b in zip(model.bounds, model.bounds[1:]))
    return model.dominant(None, "id").select(
        "id", F.col("dominant_topic").between(0, 7).alias("in_range"),
        F.col("dominant_topic_prob").between(1 / 8 - 1e-9, 1 + 1e-9).alias("is_likely"), F.lit(rises).alias("bound_rises"))


@register("lda_topic_words", """
SELECT CAST(t AS INTEGER) AS topic, CAST(r AS INTEGER) AS rank, true AS ordered, true AS weighted
FROM range(8) AS a(t), range(10) AS b(r)""")
def q_lda_topic_words(spark, sf):
    """Ten words per topic, heaviest first, each of some weight."""
    w = Window.partitionBy("topic").orderBy("rank")
    words = _topics(spark, sf).words(10).withColumn("before", F.lag("weight").over(w))
    return words.select("topic", "rank", F.coalesce(F.col("before") >= F.col("weight"), F.lit(True)).alias("ordered"),
                        ((F.col("weight") > 0) & (F.col("weight") <= 1)).alias("weighted"))


@register("argmax_first", """
SELECT vec_id, CAST(list_position(CAST(embedding AS DOUBLE[]), list_max(CAST(embedding AS DOUBLE[]))) - 1 AS BIGINT)
  AS position FROM embeddings""")
def q_argmax_first(spark, sf):
    """Position of the first maximum of every vector."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", vf.argmax(F.col("embedding")).cast("long").alias("position"))


_EMBED_TABLES = {"documents": ("doc_id", "text"), "conversations": ("conv_id", "text"), "pages": ("page_id", "html")}


@register("multi_table_embed", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", true AS ok, count(*) AS rows, CAST(NULL AS VARCHAR) AS error, count(*) AS full_width, "
    f"count(*) AS unit_or_empty FROM {t}" for t in _EMBED_TABLES))
def q_multi_table_embed(spark, sf):
    """Embed several tables and store each with its vectors (JVM TF-IDF
    encoder, written under the checkpoint folder); one summary row per table
    with the stored row count, failures reported instead of raised, and what
    is read back: vectors of full width, and of length 1 or 0."""
    from tessera.operators import batch
    from tessera.session import stage_path
    from tessera.sources import sinks
    paths = {name: stage_path(spark, f"embedded_{name}") for name in _EMBED_TABLES}

    def job(name):
        key, text = _EMBED_TABLES[name]
        rows = table(spark, sf, name).select(key, F.coalesce(text, F.lit("")).alias("text"))
        sinks.write_table(md.embed_tfidf(rows, "text"), paths[name])
        return sinks.row_count(spark, paths[name])

    done = batch.run_for_tables(spark, list(_EMBED_TABLES), job)
    read = None
    for name, path in paths.items():
        norm = F.round(vf.l2norm("embedding"), 6)
        one = spark.read.parquet(path).select("embedding").agg(
            F.count_if(F.size("embedding") == EMBEDDING_WIDTH).alias("full_width"),
            F.count_if(norm.isin(0.0, 1.0)).alias("unit_or_empty")).withColumn("table", F.lit(name))
        read = one if read is None else read.unionByName(one)
    return done.join(read, "table").select("table", "ok", "rows", "error", "full_width", "unit_or_empty")


def _terms(e: str) -> str:
    return f"regexp_extract_all(lower(coalesce({e}, '')), '{_W}{{2,}}')"


@register("find_similar_texts", f"""
WITH t AS (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS c FROM t WHERE NOT list_contains({_stop_sql()}, term) GROUP BY 1, 2),
g AS (SELECT term, sum(c) AS n, count(*) AS docs FROM tf GROUP BY term),
voc AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0::DOUBLE) / (docs + 1.0::DOUBLE)) AS idf FROM g
  WHERE docs >= 3 AND docs <= 0.5 * (SELECT count(*) FROM documents) ORDER BY n DESC, term LIMIT 500),
qt AS (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark),
qf AS (SELECT item_id, term, count(*) AS c FROM qt GROUP BY 1, 2),
dv AS (SELECT doc_id, term, c * idf AS w FROM tf JOIN voc USING (term)),
qv AS (SELECT item_id, term, c * idf AS w FROM qf JOIN voc USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dv GROUP BY doc_id),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qv GROUP BY item_id),
dot AS (SELECT item_id, doc_id, sum(dv.w * qv.w) AS d FROM qv JOIN dv USING (term) GROUP BY 1, 2),
s AS (SELECT b.item_id AS query_id, d.doc_id AS id,
        round(coalesce(dot.d / (dn.norm * qn.norm), 0.0::DOUBLE), {_TEXT_DECIMALS}) AS cosine
      FROM benchmark b CROSS JOIN documents d LEFT JOIN dot ON dot.item_id = b.item_id AND dot.doc_id = d.doc_id
      LEFT JOIN dn ON dn.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = b.item_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'doc-' || CAST(id AS VARCHAR) AS id, round((cosine + 1) / 2, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, 'doc-' || CAST(id AS VARCHAR)) AS rank FROM s)
WHERE rank <= 3""")
def q_find_similar_texts(spark, sf):
    """The three documents most like each benchmark text: one fitted encoder
    for corpus and queries, text ids."""
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text", F.lit("documents").alias("corpus"))
    model = md.fit_vocabulary_tfidf(docs, "text", "id", PROBE_STOP_WORDS)
    queries = md.encode(model, table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "text")
    top = vo.similarity_topk(md.encode(model, docs, "text"), queries, 3, decimals=_TEXT_DECIMALS)
    return top.select("query_id", "rank", "id", F.round("similarity", 6).alias("similarity"))

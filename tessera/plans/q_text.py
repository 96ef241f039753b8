"""Registered projection and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import labels
from tessera.plans import sqlbits as S
from tessera.plans.registry import register
from tessera.schemas import URL_PREFIX
from tessera.sources.tables import POSTS_SQL, posts, table, with_ctes

_P = with_ctes(POSTS_SQL)


@register("combined_text", _P + f"""
SELECT id, {S.combined_text('title', 'body_text', 1500)} AS combined_text FROM posts""")
def q_combined_text(spark, sf):
    p = posts(spark, sf)
    return p.select("id", tx.combined_text("title", "body_text", 1500).alias("combined_text"))


@register("combined_text_full", _P + f"""
SELECT id, {S.combined_text('title', 'body_text', None)} AS combined_text FROM posts""")
def q_combined_text_full(spark, sf):
    p = posts(spark, sf)
    return p.select("id", tx.combined_text("title", "body_text", None).alias("combined_text"))


_EMB = S.combined_text("title", "coalesce(nullif(body_text, ''), '')", 1500)


@register("embedding_text", _P + f"""
SELECT id, CASE WHEN {_EMB} = '' THEN 'No content' ELSE {_EMB} END AS embedding_text FROM posts""")
def q_embedding_text(spark, sf):
    p = posts(spark, sf)
    return p.select("id", tx.embedding_text("title", "body_text", max_chars=1500)
                    .alias("embedding_text"))


@register("net_sentiment", _P + """
SELECT id, pos_score - neg_score AS roberta_score FROM posts""")
def q_net_sentiment(spark, sf):
    p = posts(spark, sf)
    return p.select("id", (F.col("pos_score") - F.col("neg_score")).alias("roberta_score"))


@register("url_fallback", _P + f"""
SELECT id, coalesce(nullif(url, ''), {S.q(URL_PREFIX)} || slug) AS url FROM posts""")
def q_url_fallback(spark, sf):
    p = posts(spark, sf)
    return p.select("id", tx.url_fallback("url", "slug", URL_PREFIX).alias("url"))


@register("space_token_count", f"""
SELECT doc_id, {S.space_token_count('text')} AS n_tokens FROM documents""")
def q_space_token_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.space_token_count("text").alias("n_tokens"))


@register("word_count", f"""
SELECT doc_id, {S.word_count('text')} AS n_words FROM documents""")
def q_word_count(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.word_count("text").alias("n_words"))


@register("markdown_to_text", f"""
SELECT conv_id, turn, {S.markdown_to_text('text')} AS body_text FROM conversations""")
def q_markdown_to_text(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.markdown_to_text("text").alias("body_text"))


@register("html_to_text", f"""
SELECT page_id, {S.markdown_to_text('html')} AS body_text FROM pages""")
def q_html_to_text(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", tx.markdown_to_text("html").alias("body_text"))


@register("tag_explode", _P + """
SELECT id, trim(t) AS tag FROM posts, unnest(string_split(tags, ',')) AS u(t)
WHERE trim(t) <> ''""")
def q_tag_explode(spark, sf):
    p = posts(spark, sf)
    return p.select("id", F.explode(tx.split_tags("tags")).alias("tag"))


@register("polarity_label", _P + f"""
SELECT id,
  {S.polarity_label('pos_score - neg_score', 0.05, True)} AS vader_label,
  {S.polarity_label('pos_score - neg_score', 0.05, False)} AS tb_label
FROM posts""")
def q_polarity_label(spark, sf):
    p = posts(spark, sf)
    net = F.col("pos_score") - F.col("neg_score")
    return p.select("id", tx.polarity_label(net, 0.05, inclusive=True).alias("vader_label"),
                    tx.polarity_label(net, 0.05, inclusive=False).alias("tb_label"))


@register("chunk_words", f"""
WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 1, 300)) AS start FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(start // 300 AS INTEGER) AS chunk_no,
  CAST(len(list_slice(ws, start + 1, start + 300)) AS INTEGER) AS n_words,
  array_to_string(list_slice(ws, start + 1, start + 300), ' ') AS chunk
FROM c""")
def q_chunk_words(spark, sf):
    d = table(spark, sf, "documents")
    ch = d.select("doc_id", F.posexplode(tx.chunk_words("text", 300)).alias("chunk_no", "ws"))
    return ch.select("doc_id", "chunk_no", F.size("ws").alias("n_words"),
                     F.array_join("ws", " ").alias("chunk"))


@register("scores_to_json", _P + """
SELECT id, CASE WHEN pos_score IS NULL THEN NULL
  ELSE CAST(to_json({'positive': pos_score, 'neutral': 0.0::DOUBLE, 'negative': neg_score}) AS VARCHAR)
  END AS roberta_scores
FROM posts""")
def q_scores_to_json(spark, sf):
    p = posts(spark, sf)
    sc = labels.scores_struct(F.col("pos_score"), F.lit(0.0), F.col("neg_score"),
                              null_when=F.col("pos_score").isNull())
    return p.select("id", F.to_json(sc).alias("roberta_scores"))

"""Registered row-shaping queries: first-n, quotas, dedup, upsert, joins,
unions and the partitioned / JSON sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.operators import dedup, joins, topk
from tessera.operators import filters as fl
from tessera.plans import sqlbits as S
from tessera.plans.registry import ORACLE, register
from tessera.schemas import DEV_TOPICS, NEWS_TOPICS, UNSURE, URL_PREFIX
from tessera.session import stage_path, write_stage
from tessera.sources import sinks
from tessera.sources.readers import cursor_chains, flatten_pages, page_problems, read_year_partitions
from tessera.sources.tables import POSTS_SQL, posts, table, with_ctes
from tessera.streaming import chains

_P = with_ctes(POSTS_SQL)


@register("cluster_samples", _P + f"""
SELECT dominant_topic, id, substring({S.combined_text('title', 'body_text', 1500)}, 1, 120) AS sample
FROM posts QUALIFY row_number() OVER (PARTITION BY dominant_topic ORDER BY id) <= 10""")
def q_cluster_samples(spark, sf):
    # Clipped in front of the window, so that no full text is sorted.
    p = posts(spark, sf).select("dominant_topic", "id", F.substring(
        tx.combined_text("title", "body_text", 1500), 1, 120).alias("sample"))
    return dedup.first_n(p, ["dominant_topic"], [F.col("id")], 10)


_QUOTA = dedup.quota_size(200, 5)


@register("yearly_quota", _P + f"""
SELECT id, CAST(year(published_on) AS INTEGER) AS year, published_at FROM posts
QUALIFY row_number() OVER (PARTITION BY year(published_on) ORDER BY published_at, url, id) <= {_QUOTA}""")
def q_yearly_quota(spark, sf):
    p = posts(spark, sf).select("id", F.year("published_on").alias("year"), "published_at", "url")
    q = dedup.first_n(p, ["year"], [F.col("published_at"), F.col("url"), F.col("id")], _QUOTA)
    return q.select("id", "year", "published_at")


@register("dedup_prefix", _P + """
SELECT id, CAST(year(published_on) AS INTEGER) AS year FROM posts
QUALIFY row_number() OVER (PARTITION BY year(published_on), substring(body_text, 1, 50)
                           ORDER BY published_at, id) = 1""")
def q_dedup_prefix(spark, sf):
    # Only the key and ordering columns enter the shuffle; the text is not needed downstream.
    p = posts(spark, sf).select("id", F.year("published_on").alias("year"), "published_at",
                                F.substring("body_text", 1, 50).alias("prefix"))
    d = dedup.keep_first(p, ["year", "prefix"], ["published_at", "id"])
    return d.select("id", "year")


@register("dedup_id", """
SELECT conv_id, turn, role FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""")
def q_dedup_id(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return dedup.keep_first(c, ["conv_id"], ["turn"])


@register("earliest_matches", _P + f"""
SELECT id, published_at, title FROM posts
WHERE published_at >= TIMESTAMP '2025-01-01' AND published_at < TIMESTAMP '2026-01-01'
  AND contains(lower(body_text), 'that') AND {S.word_match('lower(body_text)', 'that')}
ORDER BY published_at, id LIMIT 10""")
def q_earliest_matches(spark, sf):
    p = posts(spark, sf)
    yr = (F.col("published_at") >= F.lit("2025-01-01").cast("timestamp")) & \
         (F.col("published_at") < F.lit("2026-01-01").cast("timestamp"))
    m = p.where(yr & fl.like_then_regex(F.col("body_text"), "that"))
    return topk.first_rows(m.select("id", "published_at", "title"),
                           [F.col("published_at"), F.col("id")], 10)


_UPSERT_COLS = ["id", "title", "url", "published_raw", "tags"]


@register("upsert_latest", _P + f"""
, existing AS (SELECT id, title, url, published_raw, tags, 0 AS v FROM posts WHERE lang <> 'de'),
updates AS (SELECT id, title || ' (updated)' AS title, coalesce(url, {S.q(URL_PREFIX)} || slug) AS url,
            published_raw, lang || ';' || tags AS tags, 1 AS v FROM posts WHERE lang IN ('de', 'en'))
SELECT id, title, url, published_raw, tags FROM (SELECT * FROM existing UNION ALL SELECT * FROM updates)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC) = 1""")
def q_upsert_latest(spark, sf):
    p = posts(spark, sf)
    existing = p.where(F.col("lang") != "de").select(*_UPSERT_COLS)
    updates = p.where(F.col("lang").isin("de", "en")).select(
        "id", F.concat("title", F.lit(" (updated)")).alias("title"), tx.url_fallback("url", "slug", URL_PREFIX).alias("url"),
        "published_raw", F.concat_ws(";", "lang", "tags").alias("tags"))
    return dedup.upsert_latest(existing, updates, ["id"])


@register("constraint_violations", _P + """
SELECT count(*) AS rows, count(*) FILTER (WHERE id IS NULL) AS null_key,
  count(*) FILTER (WHERE title IS NULL) AS null_title, count(*) FILTER (WHERE url IS NULL) AS null_url,
  count(*) - count(*) FILTER (WHERE id IS NULL) - count(DISTINCT id) AS duplicate_keys
FROM (SELECT id, title, url FROM posts UNION ALL SELECT id, title, url FROM posts WHERE lang = 'de')""")
def q_constraint_violations(spark, sf):
    p = posts(spark, sf).select("id", "title", "url")
    replayed = p.unionByName(posts(spark, sf).where(F.col("lang") == "de").select("id", "title", "url"))
    return dedup.check_constraints(replayed, ["id"], ["title", "url"])


@register("union_sources", """
SELECT CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, 'documents' AS source
FROM documents
UNION ALL
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, role AS title,
  'conversations' AS source FROM conversations""")
def q_union_sources(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("title"),
        F.lit("documents").alias("source"))
    c = table(spark, sf, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("role").alias("title"), F.lit("conversations").alias("source"))
    return d.unionByName(c)


_SERVING_ENRICHED = ["dominant_topic", "primary_label", "primary_score", "secondary_label",
                     "secondary_score", "pos_score", "neg_score"]


@register("serving_join", _P + """
SELECT p.id, p.title, p.url, p.published_at, p.dominant_topic, p.primary_label, p.primary_score,
  p.secondary_label, p.secondary_score, p.pos_score, p.neg_score, l.quality, l.toxic,
  p.pos_score - p.neg_score AS roberta_score
FROM posts p JOIN labels l ON l.doc_id = p.id""")
def q_serving_join(spark, sf):
    p = posts(spark, sf)
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    enriched = p.select("id", *_SERVING_ENRICHED).join(lab, "id", "inner")
    return joins.serving_join(enriched, p, "id", _SERVING_ENRICHED + ["quality", "toxic"],
                              ["title", "url", "published_at"], "pos_score", "neg_score")


@register("serving_join_bucketed", ORACLE["serving_join"])
def q_serving_join_bucketed(spark, sf):
    """The serving join over tables that were written bucketed by id: neither
    side is shuffled when they are joined."""
    p = posts(spark, sf)
    lab = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    enriched = p.select("id", *_SERVING_ENRICHED).join(lab, "id", "inner")
    side = uuid.uuid4().hex
    e = sinks.write_bucketed(enriched, f"enriched_{side}", ["id"], 8, stage_path(spark, "enriched"))
    raw = sinks.write_bucketed(p.select("id", "title", "url", "published_at"), f"raw_{side}", ["id"], 8, stage_path(spark, "raw"))
    return joins.serving_join(e, raw, "id", _SERVING_ENRICHED + ["quality", "toxic"], ["title", "url", "published_at"], "pos_score", "neg_score")


#: The place of each topic id in the order 6, 5, 7, 4, 1, 2, 0, 3.
_PLACE = {6: 1, 5: 2, 7: 3, 4: 4, 1: 5, 2: 6, 0: 7, 3: 8}


def _topics_sql() -> str:
    rows = [f"('{c}', {i}, {S.q(k)}, {_PLACE[i]})" for c, names in (("news", NEWS_TOPICS), ("dev", DEV_TOPICS))
            for i, k in enumerate(names)]
    return "topic_dim(corpus, topic_id, keywords, display_no) AS (VALUES " + ", ".join(rows) + ")"


@register("topic_name_lookup", with_ctes(POSTS_SQL, _topics_sql()) + """
SELECT p.id, p.corpus, CAST(p.n_chars % 10 AS INTEGER) AS topic,
  coalesce(t.keywords, CAST(CAST(p.n_chars % 10 AS INTEGER) AS VARCHAR)) AS topic_name,
  CAST(t.display_no AS INTEGER) AS display_no
FROM posts p LEFT JOIN topic_dim t ON t.corpus = p.corpus AND t.topic_id = p.n_chars % 10""")
def q_topic_name_lookup(spark, sf):
    p = posts(spark, sf).select("id", "corpus", (F.col("n_chars") % 10).cast("int").alias("topic"))
    return joins.topic_name(p, "corpus", "topic", display="display_no")


@register("label_backfill_join", _P + f"""
SELECT p.id, coalesce(CASE WHEN l.quality = 1 THEN 'TECHNICAL' WHEN l.quality = 0 THEN 'NON_TECHNICAL' END,
  '{UNSURE}') AS primary_label,
  coalesce(CAST(l.toxic AS DOUBLE) * 0.5 + 0.5, 0.0) AS primary_score
FROM posts p LEFT JOIN labels l ON l.doc_id = p.id""")
def q_label_backfill_join(spark, sf):
    lab = table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, "TECHNICAL").when(F.col("quality") == 0, "NON_TECHNICAL")
         .alias("primary_label"),
        (F.col("toxic").cast("double") * 0.5 + 0.5).alias("primary_score"))
    return joins.backfill(posts(spark, sf).select("id"), lab, "id",
                          {"primary_label": UNSURE, "primary_score": 0.0})


@register("scan_year_partition", _P + """
SELECT id, title, published_on, CAST(year(published_on) AS INTEGER) AS year FROM posts
WHERE year(published_on) IN (2021, 2023)""")
def q_scan_year_partition(spark, sf):
    p = posts(spark, sf).select("id", "title", "published_on",
                                F.year("published_on").alias("year"))
    df = read_year_partitions(spark, write_stage(p, "posts_by_year", partition_by=["year"]), [2021, 2023])
    return df.select("id", "title", "published_on", F.col("year").cast("int").alias("year"))


def _pages(spark, sf):
    """Conversations as API response pages of at most 50 posts each."""
    c = table(spark, sf, "conversations")
    node = F.struct(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.concat(F.initcap("role"), F.lit(" turn "), F.col("turn").cast("string")).alias("title"),
        F.when(F.col("turn") % 4 != 0, F.concat(F.lit("https://example.com/c/"),
                                                F.col("conv_id").cast("string"), F.lit("/"),
                                                F.col("turn").cast("string"))).alias("url"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"),
                 F.col("turn").cast("string")).alias("slug"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60),
                      "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        F.struct(F.col("text").alias("markdown")).alias("content"),
        F.array(F.struct(F.col("role").alias("name"), F.lower("role").alias("slug"))).alias("tags"))
    edges = c.groupBy("conv_id", F.floor(F.col("turn") / 50).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("turn").alias("_t"), node.alias("node")))).alias("e"))
    body = F.struct(F.struct(F.struct(F.struct(
        F.struct(F.lit(False).alias("hasNextPage"), F.lit(None).cast("string").alias("endCursor"))
         .alias("pageInfo"),
        F.transform("e", lambda x: F.struct(x["node"].alias("node"))).alias("edges")).alias("posts"))
        .alias("tag")).alias("data"))
    return edges.select(F.to_json(body).alias("value"))


@register("flatten_json_pages", f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
  upper(substring(role, 1, 1)) || lower(substring(role, 2)) || ' turn ' || CAST(turn AS VARCHAR) AS title,
  CASE WHEN turn % 4 <> 0 THEN 'https://example.com/c/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)
       ELSE {S.q(URL_PREFIX)} || 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS url,
  strftime(make_timestamp(CAST((1704067200 + conv_id * 3600 + turn * 60) * 1000000 AS BIGINT)),
    '%Y-%m-%dT%H:%M:%SZ') AS published_at,
  CAST(to_json([lower(role)]) AS VARCHAR) AS tags,
  {S.markdown_to_text('text')} AS body_text
FROM conversations""")
def q_flatten_json_pages(spark, sf):
    return flatten_pages(_pages(spark, sf), "value")


@register("page_problems", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, page, CASE WHEN conv_id % 3 = 0 THEN 'corrupt' ELSE 'errors: slow; retry' END AS problem
FROM (SELECT DISTINCT conv_id, CAST(turn // 50 AS BIGINT) AS page FROM conversations) WHERE conv_id % 3 < 2""")
def q_page_problems(spark, sf):
    """Pages that are cut off or carry errors, every one reported."""
    c = table(spark, sf, "conversations")
    page = F.floor(F.col("turn") / 50)
    sound = c.groupBy("conv_id", page.alias("page")).agg(F.count("*").alias("n"))
    body = F.concat(F.lit('{"data": {"tag": {"posts": {"edges": []}}}, "errors": '),
                    F.when(F.col("conv_id") % 3 == 1, '[{"message": "slow"}, {"message": "retry"}]').otherwise("[]"), F.lit("}"))
    pages = sound.select("conv_id", "page", F.when(F.col("conv_id") % 3 == 0, F.substring(body, 1, 30)).otherwise(body).alias("value"))
    return page_problems(pages).select("conv_id", "page", "problem")


def _chain_pages(spark, sf):
    """Every turn of a conversation as a page of its chain, with faults: a
    missing page, a way back, an end that says more follows, a page twice."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.max("turn").over(Window.partitionBy("conv_id")).alias("last"))
    kind = F.col("conv_id") % 5
    c = c.where(~((kind == 1) & (F.col("turn") == 1) & (F.col("last") > 1)))
    cursor = lambda t: F.concat(F.lit("c"), t.cast("string"))
    more = (F.col("turn") < F.col("last")) | (kind == 3)
    end = F.when((kind == 2) & (F.col("turn") == F.col("last")), F.lit("c1")).otherwise(cursor(F.col("turn") + 1))
    info = F.struct((more | (kind == 2)).alias("hasNextPage"), end.alias("endCursor"))
    body = F.to_json(F.struct(F.struct(F.struct(F.struct(info.alias("pageInfo")).alias("posts")).alias("tag")).alias("data")))
    again = F.when((kind == 4) & (F.col("turn") == 1), F.lit(2)).otherwise(F.lit(1))
    return c.select("conv_id", F.when(F.col("turn") > 0, cursor(F.col("turn"))).alias("after"), body.alias("value"), F.explode(F.sequence(F.lit(1), again)).alias("copy"))


@register("cursor_chains", """
WITH RECURSIVE c AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
p AS (SELECT conv_id, CASE WHEN turn > 0 THEN 'c' || turn ELSE '' END AS after, turn < last OR conv_id % 5 IN (2, 3) AS more,
    CASE WHEN conv_id % 5 = 2 AND turn = last THEN 'c1' ELSE 'c' || (turn + 1) END AS nxt, conv_id % 5 = 4 AND turn = 1 AS twice
  FROM c WHERE NOT (conv_id % 5 = 1 AND turn = 1 AND last > 1)),
walk AS (SELECT conv_id, after, nxt, 1 AS position, [after] AS seen FROM p WHERE after = ''
  UNION ALL SELECT p.conv_id, p.after, p.nxt, position + 1, list_append(seen, p.after) FROM walk JOIN p ON p.conv_id = walk.conv_id AND p.after = walk.nxt
  WHERE NOT list_contains(seen, p.after))
SELECT p.conv_id, nullif(p.after, '') AS after, CAST(w.position AS BIGINT) AS position,
  CASE WHEN p.twice THEN 'repeated' WHEN p.more AND f.after IS NULL THEN 'unread'
       WHEN p.after <> '' AND NOT EXISTS (SELECT 1 FROM p b WHERE b.conv_id = p.conv_id AND b.nxt = p.after) THEN 'gap'
       WHEN p.more AND wf.position <= w.position THEN 'loop' END AS problem
FROM p LEFT JOIN walk w ON w.conv_id = p.conv_id AND w.after = p.after
LEFT JOIN p f ON f.conv_id = p.conv_id AND f.after = p.nxt LEFT JOIN walk wf ON wf.conv_id = p.conv_id AND wf.after = p.nxt""")
def q_cursor_chains(spark, sf):
    """Pages in the order of their cursors, with every break reported."""
    return cursor_chains(_chain_pages(spark, sf), ["conv_id"]).select("conv_id", "after", "position", "problem")


_DEV_STEMS = ["the", "that", "with", "and", "der"]


@register("dev_ingest_chain", f"""
WITH fresh AS (
  SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
    upper(substring(role, 1, 1)) || lower(substring(role, 2)) || ' turn ' || CAST(turn AS VARCHAR) AS title,
    {S.markdown_to_text('text')} AS body_text FROM conversations),
kept AS (SELECT * FROM fresh WHERE {S.stem_hits("(title || ' ' || body_text)", _DEV_STEMS, ["and"])} >= 3),
existing AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'old' AS title, text AS body_text
             FROM conversations WHERE turn % 2 = 0)
SELECT id, title, body_text FROM kept
UNION ALL SELECT id, title, body_text FROM existing WHERE id NOT IN (SELECT id FROM kept)""")
def q_dev_ingest_chain(spark, sf):
    """Pages -> plain text -> stem filter -> upsert into the posts so far."""
    existing = table(spark, sf, "conversations").where(F.col("turn") % 2 == 0).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.lit("old").alias("title"), F.col("text").alias("body_text"))
    posts_after, _ = chains.run_dev_chain(spark, _pages(spark, sf), existing, stems=_DEV_STEMS, exact=["and"])
    return posts_after

"""Registered streaming queries: each lands its input as Parquet files under
the checkpoint folder, runs an availableNow stream to a fresh sink, and
returns the sink read back (so it is checked against the batch twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import q_filters, q_rows
from tessera.plans.registry import ORACLE, register
from tessera.session import stage_path, write_stage
from tessera.sources.tables import POSTS_SQL, posts, with_ctes
from tessera.streaming import chains
from tessera.streaming import ingest as st


def _source(spark, sf, **kw):
    """The posts as raw news records, landed in a fresh path partitioned by year;
    rebalanced first, so that their files grow with the data and not with the
    tasks that read it times the years."""
    p = posts(spark, sf).select(
        "id", F.col("body_text").alias("text"), F.col("published_raw").alias("date"), "sitename",
        "url", "title", "published_at", F.year("published_on").alias("year"))
    path = write_stage(p.hint("rebalance", "year"), "news_source", partition_by=["year"])
    return st.file_stream(spark, path, spark.read.parquet(path).schema, **kw)


@register("stream_ingest", ORACLE["news_relevance_filter"])
def q_stream_ingest(spark, sf):
    s = st.ingest_relevant(_source(spark, sf), keywords=q_filters.PROBE_KEYWORDS,
                           sources=q_filters.PROBE_SOURCES)
    sink, ck = st.fresh_dirs(spark, "ingest")
    st.run_available_now(s.select("id", "year"), sink, ck, partition_by=["year"])
    return spark.read.parquet(sink).select("id")


_DEDUP_KEYS_SQL = with_ctes(POSTS_SQL) + """
SELECT DISTINCT CAST(year(published_on) AS INTEGER) AS year, substring(body_text, 1, 50) AS prefix FROM posts"""


@register("stream_dedup", _DEDUP_KEYS_SQL)
def q_stream_dedup(spark, sf):
    """Exact prefix dedup over several micro-batches: every (year, prefix) key
    survives exactly once (which copy depends on arrival, first seen wins)."""
    src = _source(spark, sf, max_files_per_trigger=2).select(
        "id", F.col("year").cast("int").alias("year"), "published_at",
        F.substring("text", 1, 50).alias("prefix"))
    sink, ck = st.fresh_dirs(spark, "dedup_exact")
    st.dedup_stream_exact(src, sink, ck, ["year", "prefix"], ["published_at", "id"], prune_col="year")
    return spark.read.parquet(sink).select("year", "prefix")


@register("stream_dedup_watermark", _DEDUP_KEYS_SQL)
def q_stream_dedup_watermark(spark, sf):
    """Watermark-bounded dedup state; which copy survives depends on arrival."""
    s = st.dedup_prefix_stream(_source(spark, sf), "text", "year", "published_at")
    sink, ck = st.fresh_dirs(spark, "dedup")
    st.run_available_now(s.select("year", "prefix", "id"), sink, ck)
    return spark.read.parquet(sink).select(F.col("year").cast("int").alias("year"), "prefix")


@register("stream_quota", ORACLE["yearly_quota"])
def q_stream_quota(spark, sf):
    src = _source(spark, sf).select("id", F.col("year").cast("int").alias("year"), "published_at", "url")
    sink, ck = st.fresh_dirs(spark, "quota")
    st.quota_stream(src, sink, ck, "year", ["published_at", "url", "id"], q_rows._QUOTA)
    return spark.read.parquet(sink).select("id", "year", "published_at")


def _waves(spark, sf):
    """Three waves of updates, versions 1..3."""
    p = posts(spark, sf)
    waves = [
        (1, p.where(F.col("lang") == "en"), " v1"),
        (2, p.where(F.col("lang") == "de"), " v2"),
        (3, p.where((F.col("lang") == "en") & (F.col("n_chars") > 2000)), " v3"),
    ]
    return [rows.select("id", F.concat("title", F.lit(tag)).alias("title"), "tags", F.lit(v).alias("version")) for v, rows, tag in waves]


@register("stream_upsert", with_ctes(POSTS_SQL) + """
, u AS (
  SELECT id, title, tags, 0 AS version FROM posts WHERE lang <> 'de'
  UNION ALL SELECT id, title || ' v1', tags, 1 FROM posts WHERE lang = 'en'
  UNION ALL SELECT id, title || ' v2', tags, 2 FROM posts WHERE lang = 'de'
  UNION ALL SELECT id, title || ' v3', tags, 3 FROM posts WHERE lang = 'en' AND n_chars > 2000)
SELECT id, title, tags, version FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def q_stream_upsert(spark, sf):
    """Three landed waves, one micro-batch each: the stream goes on after every
    wave, which all tasks that read the posts have written."""
    path = stage_path(spark, "upsert_updates")
    initial = posts(spark, sf).where(F.col("lang") != "de").select(
        "id", "title", "tags", F.lit(0).alias("version"))
    root, ck = st.fresh_dirs(spark, "upsert")
    for wave in _waves(spark, sf):
        wave.write.mode("append").parquet(path)
        st.upsert_stream(st.file_stream(spark, path, wave.schema), initial, root, ck, ["id"], "version", compact_every=2)
    return st.read_upserts(spark, root, ["id"], "version").select("id", "title", "tags", "version")


_CHAIN_QUOTA = 20


def _chain_sql() -> str:
    relevant = ORACLE["news_relevance_filter"]
    return with_ctes(POSTS_SQL) + f"""
, rel AS ({relevant}),
d AS (SELECT id, CAST(substring(published_raw, 1, 4) AS INTEGER) AS year, published_at FROM posts
      WHERE id IN (SELECT id FROM rel)
      QUALIFY row_number() OVER (PARTITION BY substring(published_raw, 1, 4), substring(body_text, 1, 50)
                                 ORDER BY published_at, id) = 1)
SELECT id, year FROM d QUALIFY row_number() OVER (PARTITION BY year ORDER BY published_at, id) <= {_CHAIN_QUOTA}"""


_RELEVANT = {"keywords": q_filters.PROBE_KEYWORDS, "sources": q_filters.PROBE_SOURCES}


@register("news_ingest_chain", _chain_sql())
def q_news_ingest_chain(spark, sf):
    """Filter -> prefix dedup -> quota in one batch operation."""
    p = posts(spark, sf).select("id", F.col("body_text").alias("text"), F.col("published_raw").alias("date"), "sitename",
                                "published_at")
    return chains.news_chain(p, _CHAIN_QUOTA, ["published_at", "id"], **_RELEVANT).select("id", "year")


@register("stream_news_chain", _chain_sql())
def q_stream_news_chain(spark, sf):
    """The same chain over landed files."""
    sink, ck = st.fresh_dirs(spark, "news_chain")
    kept = chains.news_chain_stream(_source(spark, sf).drop("year"), sink, ck, _CHAIN_QUOTA, ["published_at", "id"],
                                    **_RELEVANT)
    return spark.read.parquet(kept).select("id", "year")

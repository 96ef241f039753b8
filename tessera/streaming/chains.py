"""The two ingest jobs as whole chains.

News: relevance filter -> one row per (year, text prefix) -> yearly quota.
Developer posts: API pages -> plain text -> stem filter -> upsert by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dedup
from tessera.operators import filters as fl
from tessera.session import stage_table
from tessera.sources.readers import flatten_pages, page_problems
from tessera.streaming import ingest as st

PREFIX = 50


def news_chain(news: DataFrame, quota: int, order: list[str], text: str = "text", date: str = "date",
               source: str = "sitename", **relevance) -> DataFrame:
    """Relevant rows, one per (year, first ``PREFIX`` characters), at most
    ``quota`` per year, both by ``order`` (ending in a unique column).  The
    year is the date's."""
    kept = news.where(fl.relevance(F.col(text), F.col(date), F.col(source), **relevance))
    dated = kept.withColumn("year", F.substring(F.col(date), 1, 4).cast("int"))
    once = dedup.dedup_prefix(dated, text, ["year"], order, PREFIX)
    return dedup.first_n(once, ["year"], [F.col(c) for c in order], quota)


def news_chain_stream(stream: DataFrame, sink: str, ckpt: str, quota: int, order: list[str], text: str = "text",
                      date: str = "date", source: str = "sitename", **relevance) -> str:
    """The same over files as they land: what a batch keeps counts for every
    later one.  Two jobs in a row, each restartable: filter and prefix dedup
    into ``sink/unique``, quota from there into ``sink/kept``."""
    spark = stream.sparkSession
    kept = st.ingest_relevant(stream, text, date, source, **relevance)
    keyed = (kept.withColumn("year", F.substring(F.col(date), 1, 4).cast("int"))
             .withColumn("prefix", F.substring(F.col(text), 1, PREFIX)))
    unique = f"{sink}/unique"
    st.dedup_stream_exact(keyed, unique, f"{ckpt}/unique", ["year", "prefix"], order, prune_col="year")
    landed = st.file_stream(spark, unique, keyed.schema).drop("batch")
    st.quota_stream(landed, f"{sink}/kept", f"{ckpt}/kept", "year", order, quota)
    return f"{sink}/kept"


def dev_chain(pages: DataFrame, existing: DataFrame, page_col: str = "value", **stems) -> tuple[DataFrame, DataFrame]:
    """(posts after the upsert, pages with a problem).  ``existing`` holds the
    posts so far; relevant posts of the pages replace those of the same id,
    the last one by (published_at, url) if an id comes more than once."""
    fresh = fl.stem_filter(flatten_pages(pages, page_col), "title", "body_text", out="_hits", **stems).drop("_hits")
    latest = dedup.keep_last(fresh.where(F.col("id").isNotNull()), ["id"], ["published_at", "url"])
    return dedup.upsert_latest(existing, latest.select(*existing.columns), ["id"]), page_problems(pages, page_col)


def run_dev_chain(spark: SparkSession, pages: DataFrame, existing: DataFrame, **stems) -> tuple[DataFrame, DataFrame]:
    """``dev_chain`` with both results written under the checkpoint folder."""
    posts, problems = dev_chain(pages, existing, **stems)
    return stage_table(posts, "dev_posts"), stage_table(problems, "page_problems")

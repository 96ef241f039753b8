"""Sources: partitioned Parquet, CSV directories, JSON API pages, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.schemas import NEWS_CSV, PAGE_RESPONSE, URL_PREFIX
from tessera.session import stage_table


def read_year_partitions(spark: SparkSession, root: str, years: list[int] | None = None,
                         schema: T.StructType | None = None) -> DataFrame:
    """Parquet laid out as ``root/year=YYYY/*.parquet``; the ``year`` predicate
    prunes directories before any file is opened."""
    r = spark.read.option("basePath", root)
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(root)
    return df.where(F.col("year").isin(years)) if years else df


def read_csv_dir(spark: SparkSession, paths: str | list[str], schema: T.StructType = NEWS_CSV,
                 rename: dict[str, str] | None = None) -> DataFrame:
    """CSV files (header, quoted multi-line bodies) with an explicit schema,
    searched recursively; optional column renames (e.g. sitename -> source)."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
               .option("escape", '"').option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.csv").csv(paths))
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    return df


def read_side_csv(spark: SparkSession, path: str) -> DataFrame:
    """A small side table whose schema is unknown in advance (inferred)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, name: str, allowed: list[str]) -> DataFrame:
    """Catalog table by name, checked against an allow-list (no string-built SQL)."""
    if name not in allowed:
        raise ValueError(f"table {name!r} not allowed")
    return spark.table(name)


def page_problems(pages: DataFrame, page_col: str = "value") -> DataFrame:
    """The input's columns plus ``problem`` for pages that are not as they
    should be: ``corrupt`` (not JSON, or cut off), ``errors`` (the API's own
    messages, joined) or ``no data``; sound pages give no row.  Kept beside
    ``flatten_pages``, so that nothing a page lacks goes unseen."""
    schema = T.StructType([*PAGE_RESPONSE.fields, T.StructField("_corrupt", T.StringType())])
    p = F.from_json(F.col(page_col), schema, {"columnNameOfCorruptRecord": "_corrupt"})
    said = F.array_join(F.transform(F.coalesce(F.col("_p.errors"), F.array()), lambda e: e["message"]), "; ")
    blank = F.trim(F.coalesce(F.col(page_col), F.lit(""))) == ""
    problem = (F.when(blank | F.col("_p._corrupt").isNotNull(), F.lit("corrupt"))
               .when(said != "", F.concat(F.lit("errors: "), said))
               .when(F.col("_p.data.tag.posts.edges").isNull(), F.lit("no data")))
    return pages.withColumn("_p", p).withColumn("problem", problem).where("problem is not null").drop("_p")


def flatten_pages(pages: DataFrame, page_col: str = "value", url_prefix: str = URL_PREFIX) -> DataFrame:
    """API response pages (JSON text, one per row) to article rows.

    Rows that do not parse yield no articles instead of failing the job
    (``page_problems`` reports them); data beside ``errors`` is used.  Missing
    URL falls back to prefix + slug; tags become a JSON array of slugs;
    markdown becomes plain text.
    """
    parsed = pages.select(F.from_json(F.col(page_col), PAGE_RESPONSE).alias("p"))
    nodes = parsed.select(F.explode("p.data.tag.posts.edges").alias("e")).select("e.node.*")
    return nodes.select(
        F.col("id"),
        F.col("title"),
        tx.url_fallback("url", "slug", url_prefix).alias("url"),
        F.col("publishedAt").alias("published_at"),
        F.to_json(F.transform(F.coalesce(F.col("tags"), F.array()), lambda t: t["slug"])).alias("tags"),
        tx.markdown_to_text(F.coalesce(F.col("content.markdown"), F.lit(""))).alias("body_text"),
    )


def cursor_chains(pages: DataFrame, chain: list[str], after_col: str = "after", page_col: str = "value") -> DataFrame:
    """Follow cursor-paged responses from page to page and report where a chain
    breaks.

    A row holds one response and the cursor it was asked with (null for the
    first page) within its chain (columns ``chain``).  Returns (chain, after,
    end_cursor, has_next, position, problem), one row per chain and cursor:
    ``position`` counts pages from the first, null if no way leads from there.
    Problems, the first that holds: ``repeated`` (several responses to one
    cursor; the smallest end cursor is followed), ``corrupt`` (no page info),
    ``no cursor`` (more pages are said to follow, but not after what),
    ``unread`` (the next page is missing), ``gap`` (no page ends with this
    cursor), ``loop`` (the next page is this one or one before it, or the page
    lies on a circle that no first page leads to).

    Pages are numbered by jumps that double in each round, so a chain of n
    pages takes about log2(n) joins; pages that have arrived are set aside.
    """
    info = F.from_json(F.coalesce(F.col(page_col), F.lit("")), PAGE_RESPONSE)["data"]["tag"]["posts"]["pageInfo"]
    keys = F.struct(*[F.col(c) for c in chain]) if chain else F.lit(0)
    read = pages.select(keys.alias("chain"), F.coalesce(after_col, F.lit("")).alias("after"), info.alias("i")).select(
        "chain", "after", F.col("i.endCursor").alias("end"), F.col("i.hasNextPage").alias("more"), F.col("i").isNotNull().alias("sound"))
    one = stage_table(read.groupBy("chain", "after").agg(
        F.min("end").alias("end"), F.max("more").alias("more"), F.max("sound").alias("sound"), F.count(F.lit(1)).alias("n")), "cursors")
    # A page comes after the page that ends with its cursor, of several the one with the smallest cursor.
    before = stage_table(one.where(F.col("end").isNotNull()).groupBy("chain", F.col("end").alias("after")).agg(F.min("after").alias("jump")), "before")
    now = one.select("chain", "after").join(before, ["chain", "after"], "left").select(
        "chain", "after", F.when(F.col("after") != "", F.col("jump")).alias("jump"), F.lit(1).cast("long").alias("far"))
    # ``far`` steps lead from a page to ``jump``; a page without one is a root.
    state = stage_table(now.select("chain", "after", "jump", F.when(F.col("jump").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("far"),
                                   F.when(F.col("jump").isNull(), F.col("after")).alias("root")), "jumps")
    for _ in range(max(one.count(), 1).bit_length() + 1):  # whoever has not arrived by then goes round in a circle
        if state.where("root IS NULL").isEmpty():
            break
        to = state.select("chain", F.col("after").alias("jump"), F.col("jump").alias("next"), F.col("far").alias("further"), F.col("root").alias("reached"))
        moved = state.where("root IS NULL").join(to, ["chain", "jump"]).select(
            "chain", "after", F.coalesce("next", "jump").alias("jump"), (F.col("far") + F.col("further")).alias("far"), F.col("reached").alias("root"))
        state = stage_table(state.where("root IS NOT NULL").unionByName(moved), "jumps")
    place = state.select("chain", "after", F.when(F.col("root") == "", F.col("far") + 1).alias("position"), F.col("root").isNull().alias("circle"))
    at = one.join(place, ["chain", "after"])
    following = place.select("chain", F.col("after").alias("end"), F.col("position").alias("next_position"), F.lit(True).alias("held"))
    known = at.join(following, ["chain", "end"], "left").join(before.select("chain", "after", F.lit(True).alias("led")), ["chain", "after"], "left")
    follows = F.coalesce(F.col("more"), F.lit(False))
    problem = (F.when(F.col("n") > 1, "repeated").when(~F.col("sound"), "corrupt").when(follows & F.col("end").isNull(), "no cursor")
               .when(follows & F.col("held").isNull(), "unread").when((F.col("after") != "") & F.col("led").isNull(), "gap")
               .when(F.col("circle") | (follows & (F.col("next_position") <= F.col("position"))), "loop"))
    return known.select(*[F.col("chain")[c].alias(c) for c in chain], F.nullif("after", F.lit("")).alias("after"), F.col("end").alias("end_cursor"),
                        F.col("more").alias("has_next"), "position", problem.alias("problem"))

"""Main text of web pages by wrapper induction.

The pages of a host are reduced to trees of block elements; each tree is
aligned by simple tree matching with the host's most common one, which gives
every text a slot.  A text that most of the host's different pages hold in one
slot is template, what varies is content.  Elements and names that stand for
menus, adverts, forms, comments and the like never hold content, and where a
page marks an article only its slots count.

Only skeletons, hashes and counts are gathered per host, each pre-aggregated;
no task ever holds the pages of a host.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.html_tree import Page, align, hash64

#: A text is template in a slot that this share of the host's different pages
#: fill with it, on so many pages at least; inside a marked article more is asked for.
SHARE, PAGES = 0.5, 3
ARTICLE_SHARE, ARTICLE_PAGES = 0.9, 8

_cached_align = lru_cache(4096)(align)


def _outline(batches):
    """Per page its skeleton, a hash of its content, and node and hash of each
    block that could be content."""
    for batch in batches:
        rows = []
        for html in batch.column("html").to_pylist():
            page = Page(html or "")
            blocks = [(page.numbered[id(b.node)], hash64(b.text)) for b in page.blocks if not b.marked]
            rows.append((page.skeleton, hash64(page.skeleton), hash64(repr([h for _, h in blocks])),
                         [n for n, _ in blocks], [h for _, h in blocks]))
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                         names=["host", "skeleton", "sh", "content", "nodes", "texts"])


def _aligned(batches):
    for batch in batches:
        slots = [_cached_align(a, b) for a, b in zip(batch.column("skeleton").to_pylist(),
                                                     batch.column("ref").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("sh"),
                                          pa.array(slots, pa.list_(pa.int64()))], names=["host", "sh", "slots"])


_BLOCKS = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("text", pa.string()),
                              ("article", pa.bool_())]))


def _content(batches):
    """Per page its blocks that the marks leave."""
    for batch in batches:
        skeletons, blocks = [], []
        for html in batch.column("html").to_pylist():
            page = Page(html or "")
            skeletons.append(hash64(page.skeleton))
            left = [b for b in page.blocks if not b.marked]
            if any(b.article for b in left):
                left = [b for b in left if b.article]
            else:
                left = [b for b in left if not b.linked]
            blocks.append([{"node": page.numbered[id(b.node)], "hash": hash64(b.text), "text": b.text,
                            "article": b.article} for b in left])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("host"), pa.array(skeletons, pa.int64()),
                                          pa.array(blocks, _BLOCKS)], names=["key", "host", "sh", "blocks"])


def _host(url):
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, sh, template): for every host and skeleton the (node, hash) of
    template texts; ``strong`` ones also count inside an article."""
    outline = stage(pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
                    .mapInArrow(_outline, "host long, skeleton string, sh long, content long, "
                                          "nodes array<int>, texts array<long>"))
    kinds = outline.groupBy("host", "sh").agg(F.first("skeleton").alias("skeleton"), F.count("*").alias("n"))
    ref = kinds.groupBy("host").agg(F.max(F.struct("n", "sh", "skeleton")).alias("top")).select(
        "host", F.col("top.skeleton").alias("ref"))
    slots = stage(kinds.join(ref, "host").select("host", "sh", "skeleton", "ref")
                  .mapInArrow(_aligned, "host long, sh long, slots array<long>"))
    by_node = slots.select("host", "sh", F.posexplode("slots").alias("node", "slot"))
    held = (outline.select("host", "sh", "content", F.explode(F.arrays_zip("nodes", "texts")).alias("b"))
            .select("host", "sh", "content", F.col("b.nodes").alias("node"), F.col("b.texts").alias("hash")).distinct()
            .groupBy("host", "sh", "node", "hash").agg(F.count("*").alias("c")))
    texts = (held.join(by_node, ["host", "sh", "node"]).groupBy("host", "slot", "hash").agg(F.sum("c").alias("c"))
             .where(F.col("c") >= PAGES))
    filled = (outline.select("host", "sh", "content").distinct().groupBy("host", "sh").agg(F.count("*").alias("p"))
              .join(slots, ["host", "sh"]).select("host", "p", F.explode(F.array_distinct("slots")).alias("slot"))
              .groupBy("host", "slot").agg(F.sum("p").alias("p")))
    share = F.col("c") / F.col("p")
    fixed = texts.join(filled, ["host", "slot"]).where(share >= SHARE).select(
        "host", "slot", "hash", ((share >= ARTICLE_SHARE) & (F.col("c") >= ARTICLE_PAGES)).alias("strong"))
    return by_node.join(fixed, ["host", "slot"]).groupBy("host", "sh").agg(
        F.collect_list(F.struct("node", "hash", "strong")).alias("template"))


def extract(pages: DataFrame, key: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Columns ``key``, ``text`` (blocks in page order, joined by an empty line;
    empty if none) and ``n_chars``.

    Defined cases: null and empty pages have an empty text; a null or
    unreadable url counts as one host of its own; repeated pages are told apart
    by nothing and counted once when templates are found, so copies make no
    template; a truncated tag, comment or script at the end is dropped.  Other
    columns play no part.
    """
    marked = stage(wrappers(pages, url_col, html_col))
    read = pages.select(F.struct(*[F.col(c) for c in key]).alias("key"), _host(F.col(url_col)).alias("host"),
                        F.col(html_col).alias("html"))
    key_type = read.schema["key"].dataType.simpleString()
    blocks = read.mapInArrow(_content, f"key {key_type}, host long, sh long, "
                                       "blocks array<struct<node:int,hash:bigint,text:string,article:boolean>>")
    both = blocks.join(marked, ["host", "sh"], "left")

    def stays(b):
        return ~F.exists(F.col("template"), lambda t: (t["node"] == b["node"]) & (t["hash"] == b["hash"])
                         & (t["strong"] | ~b["article"]))

    kept = F.when(F.col("template").isNull(), F.col("blocks")).otherwise(F.filter("blocks", stays))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    out = both.select("key", text.alias("text"))
    return out.select(*[F.col("key")[c].alias(c) for c in key], "text", F.length("text").cast("long").alias("n_chars"))

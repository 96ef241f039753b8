"""Prefix trie of conversations, built as a z-fast trie.

A conversation is the row of its turns; each of its prefixes is known by a
128-bit chained hash.  The trie is kept compacted: a node covers the depths
``top + 1`` to ``depth`` at which nothing branches or ends, and is hashed under
its *handle*, the prefix whose length has the most trailing zero bits among
those depths.  A fat binary search over prefix lengths finds the deepest node
whose handle a conversation begins with, in about log2(turns) lookups; one more
lookup by first turn finds the edge on which the conversation leaves the trie.

Conversations are inserted in batches.  A batch is located as a whole (each step
of the search is one join with the handles); edges are cut where conversations
leave them or end, and of all that leave at one place with the same turn one,
drawn by its hash, becomes a leaf.  The others of that place try again in the
next batch; as the leaf is drawn at random, few batches are needed even where
every conversation branches off the one before.

A conversation's turns count as one row (24 bytes a turn); no group of
conversations is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Ids that are joined into one text before they are hashed in order.
IDS = 256
ROOT = b""
PATH = "array<struct<h: binary, s: bigint>>"
NODES = f"node binary, parent binary, top int, depth int, base bigint, first binary, handle binary, edge {PATH}"


# -- conversations -------------------------------------------------------------

def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): turns as (hash of role and text, code points of the
    text), by turn number, null first, turns of one number by their hash.  Null
    role or text is empty; rows without conv_id belong to no conversation;
    repeated rows are repeated turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", turn.alias("h"), F.length(text).alias("n")).alias("t"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return by.select("conv_id", F.transform("ts", lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("turns"))


def rebuild(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation
    c - c % group (fewer if that has fewer, none if it is absent), followed by
    its own turns after the first h; h is the crc32 of c as text, modulo ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("begin"))
    own = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    begin = F.coalesce(F.slice("begin", F.lit(1), F.col("h")), F.slice("turns", F.lit(1), F.lit(0)))
    return own.join(base, "base", "left").select(
        "conv_id", F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _path(turns: Column) -> Column:
    """Hash of every prefix and code points up to there."""
    @F.arrow_udf(PATH)
    def chained(column: pa.Array) -> pa.Array:
        rows = []
        for row in column:
            h, s, path = ROOT, 0, []
            for t in row.as_py():
                h, s = hashlib.blake2b(h + t["h"], digest_size=16).digest(), s + t["n"]
                path.append({"h": h, "s": s})
            rows.append(path)
        return pa.array(rows, pa.list_(pa.struct([("h", pa.binary()), ("s", pa.int64())])))
    return chained(turns)


def paths(convs: DataFrame) -> DataFrame:
    """(conv_id, end, path); ``end`` is the hash of the whole conversation,
    that of one without turns is empty."""
    made = convs.select("conv_id", _path(F.col("turns")).alias("path"))
    return made.select("conv_id", F.coalesce(F.get("path", F.size("path") - 1)["h"], F.lit(ROOT)).alias("end"), "path")


# -- the trie ------------------------------------------------------------------

def _hash_at(path: str, depth: str, top: str = "0") -> Column:
    """Hash of the prefix of a length, from a path that begins below ``top``."""
    return F.expr(f"CASE WHEN {depth} = 0 THEN X'' ELSE get({path}, {depth} - {top} - 1).h END")


def _fattest(low: str, high: str) -> str:
    """The length in (low, high] with the most trailing zero bits."""
    return f"({high} & shiftleft(-1, length(bin({low} ^ {high})) - 1))"


def _nodes(df: DataFrame) -> DataFrame:
    """Nodes from (parent, top, depth, base, edge)."""
    handle = F.expr(f"get(edge, {_fattest('top', 'depth')} - top - 1).h")
    return df.select(F.expr("get(edge, depth - top - 1).h").alias("node"), "parent", "top", "depth", "base",
                     F.expr("get(edge, 0).h").alias("first"), handle.alias("handle"), "edge")


def exit_nodes(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """Fat binary search: (end, at, at_depth, at_first) for every string, the
    deepest node whose handle it begins with (the root if none)."""
    handles = nodes.select("handle", F.col("depth").alias("e"), F.col("node").alias("to"), F.col("first").alias("to_first"))
    now = strings.select("end", F.lit(0).alias("l"), F.size("path").alias("r"), F.transform("path", lambda p: p["h"]).alias("part"),
                         F.lit(ROOT).alias("at"), F.lit(0).alias("at_depth"), F.lit(None).cast("binary").alias("at_first"))
    over = []
    while True:
        asked = now.where("l < r").withColumn("f", F.expr(_fattest("l", "r"))).withColumn("probe", F.expr("get(part, f - l - 1)"))
        hit = asked.join(handles, F.col("probe") == F.col("handle"), "left")
        low, high = F.coalesce("e", "l"), F.when(F.col("e").isNull(), F.col("f") - 1).otherwise(F.col("r"))
        now = stage(hit.select(
            "end", low.alias("l"), high.alias("r"),
            F.slice("part", F.coalesce("e", "l") - F.col("l") + 1, F.greatest(high - low, F.lit(0))).alias("part"),
            F.coalesce("to", "at").alias("at"), F.coalesce("e", "at_depth").alias("at_depth"),
            F.coalesce("to_first", "at_first").alias("at_first")))
        over.append(now.where("l >= r").select("end", "at", "at_depth", "at_first"))
        if now.where("l < r").isEmpty():
            return reduce(DataFrame.union, over)


def locate(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """(end, path, common, on, on_depth) for every string of ``strings`` (end,
    path): how many of its turns the trie holds in a row from the root, and
    the node on whose edge it leaves the trie or ends (null: at a node's own
    depth)."""
    at = strings.where("size(path) > 0").join(exit_nodes(nodes, strings.where("size(path) > 0")), "end")
    whole = (F.size("path") >= F.col("at_depth")) & (_hash_at("path", "at_depth") == F.col("at"))
    key = F.when(whole, F.expr("get(path, at_depth).h")).otherwise(F.col("at_first"))
    edges = nodes.select(F.col("first").alias("key"), F.col("node").alias("on"), F.col("depth").alias("on_depth"),
                         F.col("top").alias("on_top"), F.transform("edge", lambda p: p["h"]).alias("on_edge"))
    met = at.withColumn("key", key).join(edges, "key", "left")
    own = F.expr("transform(slice(path, on_top + 1, size(on_edge)), p -> p.h)")
    common = F.col("on_top") + F.size(F.array_intersect("on_edge", own))
    return met.select("end", "path", F.coalesce(common, "at_depth").alias("common"), "on", "on_depth")


def _insert(nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie after one batch, and the strings that became leaves (end, born)."""
    leaving = found.where("size(path) > common").withColumn("branch", F.expr("get(path, common).h"))
    drawn = stage(leaving.groupBy("branch").agg(F.min_by(F.struct("end", "path", "common"), "end").alias("x")).select("x.*"))
    before = F.expr("CASE WHEN common = 0 THEN 0L ELSE get(path, common - 1).s END")
    leaves = drawn.select(_hash_at("path", "common").alias("parent"), F.col("common").alias("top"),
                          F.size("path").alias("depth"), before.alias("base"),
                          F.expr("slice(path, common + 1, size(path) - common)").alias("edge"))
    cuts = stage(found.where("common < on_depth").groupBy(F.col("on").alias("node")).agg(F.array_sort(F.collect_set("common")).alias("cuts")))
    cut = nodes.join(cuts, "node").select(
        "parent", "top", "base", "edge", F.expr("concat(array(top), cuts, array(depth))").alias("b"))
    cut = cut.select("*", F.explode(F.expr("sequence(1, size(b) - 1)")).alias("i")).select(
        "*", F.expr("get(b, i - 1)").alias("t"), F.expr("get(b, i)").alias("d"))
    parts = cut.select(F.expr("CASE WHEN t = top THEN parent ELSE get(edge, t - top - 1).h END").alias("parent"),
                       F.col("t").alias("top"), F.col("d").alias("depth"),
                       F.expr("CASE WHEN t = top THEN base ELSE get(edge, t - top - 1).s END").alias("base"),
                       F.expr("slice(edge, t - top + 1, d - t)").alias("edge"))
    trie = nodes.join(cuts, "node", "left_anti").unionByName(_nodes(parts.unionByName(leaves)))
    return stage(trie), drawn.select("end", before.alias("born"))


def build(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compacted trie of distinct strings (end, path) and, for each string
    that became a leaf when it was inserted, the code points that the trie held
    of it before (end, born).  No strings make no nodes."""
    nodes = strings.sparkSession.createDataFrame([], NODES)
    born, pending = [], strings.where("size(path) > 0").select("end", "path")
    first = True
    while first or not pending.isEmpty():
        # Nothing is found in an empty trie.
        found = pending.selectExpr("end", "path", "0 AS common", "CAST(NULL AS BINARY) AS on", "CAST(NULL AS INT) AS on_depth") \
            if first else stage(locate(nodes, pending))
        nodes, new = _insert(nodes, found)
        born.append(new)
        pending = stage(found.where("size(path) > common").select("end", "path").join(new, "end", "left_anti"))
        first = False
    return nodes, reduce(DataFrame.union, born)


# -- nodes at every depth ------------------------------------------------------

def _digests(convs: DataFrame) -> DataFrame:
    """(end, sha): SHA-256 of the ascending ids of each conversation's copies.
    A digest takes its ids in order; they are joined in runs first and streamed
    through the hash, so neither memory nor a task's rows grow with the copies
    themselves."""
    runs = convs.groupBy("end", F.floor(F.col("conv_id") / IDS).alias("run")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, sha = None, None
        for batch in batches:
            done = []
            for e, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if e != end:
                    if end is not None:
                        done.append((end, sha.hexdigest()))
                    end, sha = e, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()),
                                              pa.array([d[1] for d in done], pa.string())], ["end", "sha"])
        if end is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([sha.hexdigest()])], ["end", "sha"])

    return (runs.repartition("end").sortWithinPartitions("end", "run").select("end", "ids")
            .mapInArrow(digest, "end binary, sha string"))


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns):
    ``node`` and ``parent`` (prefix hashes), conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a node are the conversations that begin with its prefix; a
    conversation without turns belongs to the root only.  Sums over a subtree
    come from its members: a string's code points below a node count once for
    every copy, and once less where the string was the first to bring them into
    the trie.  Without conversations there is no row."""
    convs = stage(paths(convs))
    strings = stage(convs.groupBy("end").agg(F.count(F.lit(1)).alias("copies"), F.min("conv_id").alias("least"),
                                             F.first("path").alias("path")))
    nodes, born = build(strings)
    children = stage(nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children")))
    total = F.expr("CASE WHEN size(path) = 0 THEN 0L ELSE get(path, size(path) - 1).s END")
    known = strings.select("end", "copies", "least", "path", total.alias("total")).join(born, "end", "left").join(
        children.select(F.col("node").alias("end"), "children"), "end", "left").select(
        "copies", "least", "path", "total", F.coalesce("born", "total").alias("born"),
        F.col("children").isNull().cast("long").alias("leaf"))
    known = stage(known)
    saved = F.sum(F.expr("copies * (total - s0) - (total - greatest(s0, born))"))
    sums = [F.sum("copies").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("leaf").alias("n_leaves"), saved.alias("saved")]
    steps = known.select("copies", "least", "total", "born", "leaf", F.explode(F.expr(
        "transform(path, (p, i) -> named_struct('h', p.h, 's0', CASE WHEN i = 0 THEN 0L ELSE get(path, i - 1).s END))")).alias("p"))
    steps = steps.select("copies", "least", "total", "born", "leaf", F.col("p.h").alias("node"), F.col("p.s0").alias("s0"))
    inner = steps.join(nodes.select("node"), "node").groupBy("node").agg(*sums)
    root = known.withColumn("s0", F.lit(0).cast("long")).agg(*sums).where("n_convs IS NOT NULL").select(F.lit(ROOT).alias("node"), "*")
    stats = stage(inner.unionByName(root))
    top = root.select("node", F.lit(None).cast("binary").alias("parent"), F.lit(-1).alias("top"), F.lit(0).alias("depth"),
                      F.lit(0).cast("long").alias("base"), F.array(F.struct(F.lit(ROOT).alias("h"), F.lit(0).cast("long").alias("s"))).alias("edge"))
    every = nodes.select("node", "parent", "top", "depth", "base", "edge").union(top)
    rows = (every.join(stats, "node").join(children, "node", "left")
            .join(_digests(convs.select("end", "conv_id")).withColumnRenamed("end", "node"), "node", "left")
            .join(stats.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv")), "parent", "left"))
    at = rows.select("*", F.explode(F.sequence(F.col("top") + 1, F.col("depth"))).alias("d"))
    ends, starts = F.col("d") == F.col("depth"), F.col("d") == F.col("top") + 1
    until = "CASE WHEN {0} - 1 <= top THEN base ELSE get(edge, {0} - 2 - top).s END"
    here = F.expr("get(edge, d - top - 1).h")
    above = F.when(starts, F.col("parent")).otherwise(F.expr("get(edge, d - top - 2).h"))
    return at.select(
        here.alias("node"), above.alias("parent"), "conv_id", F.col("d").cast("long").alias("depth"),
        F.when(starts, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(ends, F.coalesce("children", F.lit(0))).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") + (F.col("n_convs") - 1) * (F.expr(until.format("depth")) - F.expr(until.format("d")))).alias("saved_tokens"),
        F.when(ends & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))

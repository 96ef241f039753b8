"""Approximate nearest neighbours by robust-pruned directed graphs.

Distinct vectors are dealt into shards of bounded size.  In each shard a graph
is built in one pass: greedy beam searches over the graph so far propose
neighbours for the next vectors, relaxed distance pruning keeps a diverse few
of them, and reverse edges are added and pruned alike.  Every query is then
answered by a beam search in each shard, and the shards' answers are merged.
All searches of a batch advance together, so the work is array arithmetic.

Largest inner product becomes smallest distance by one more coordinate that
gives all vectors of a shard the same norm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

SHARD = 8192  # vectors per shard, about
QUERIES = 32_768  # queries per task, about
DEGREE, CAPACITY = 24, 48  # edges kept by a pruning, and held before the next one
RELAX = 1.2
BUILD_BEAM, SEARCH_BEAM = 40, 96
ENTRIES = 32
BATCH = 512
EXPAND = 4


class Graph:
    """A navigable graph over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray):
        x = np.asarray(vectors, np.float32)
        norms = (x.astype(np.float64) ** 2).sum(axis=1)
        lift = np.sqrt(np.maximum(0.0, norms.max(initial=0.0) - norms)).astype(np.float32)
        order = np.random.default_rng(8).permutation(len(x))
        self.rows = order  # graph position -> input row
        self.x = np.ascontiguousarray(np.concatenate([x, lift[:, None]], axis=1)[order])
        self.norm = (self.x ** 2).sum(axis=1)
        self.edges = np.full((len(x), CAPACITY), -1, np.int32)
        self.degree = np.zeros(len(x), np.int64)
        self.size = 0
        while self.size < len(x):
            self._insert(min(len(x), self.size + min(BATCH, max(ENTRIES, self.size // 2))))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and squared distances (less the query's norm) of the
        ``beam`` nearest found for each query, nearest first; -1 pads."""
        b, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((b, self.size + 1), bool)  # the last column takes the padding
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)

        def merge(who, new):
            new = np.where(seen[who[:, None], new], -1, new)
            # one of several equal positions is enough
            order = np.argsort(new, axis=1, kind="stable")
            new = np.take_along_axis(new, order, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            seen[who[:, None], new] = True
            seen[:, -1] = False
            d = self.norm[new] - 2 * np.einsum("brd,bd->br", self.x[new], q[who])
            d[new < 0] = np.inf
            all_ids = np.concatenate([ids[who], new], axis=1)
            all_dist = np.concatenate([dist[who], d], axis=1)
            all_done = np.concatenate([done[who], new < 0], axis=1)
            if all_dist.shape[1] > beam:
                part = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
                all_ids, all_dist, all_done = (np.take_along_axis(a, part, axis=1)
                                               for a in (all_ids, all_dist, all_done))
            order = np.argsort(all_dist, axis=1, kind="stable")
            ids[who], dist[who], done[who] = (np.take_along_axis(a, order, axis=1)
                                              for a in (all_ids, all_dist, all_done))

        merge(rows[:, 0], np.broadcast_to(np.arange(min(ENTRIES, self.size)), (b, min(ENTRIES, self.size))).copy())
        while True:
            who = np.flatnonzero((~done).any(axis=1))
            if not len(who):
                return ids, dist
            # the nearest few that have not been expanded
            rank = np.cumsum(~done[who], axis=1)
            take = ~done[who] & (rank <= EXPAND)
            done[who] |= take
            r, c = np.nonzero(take)
            new = np.full((len(who), EXPAND, CAPACITY), -1, np.int64)
            new[r, rank[r, c] - 1] = self.edges[ids[who[r], c]]
            new = new.reshape(len(who), -1)
            new = new[:, (new >= 0).any(axis=0)]
            if new.shape[1]:
                new[new >= self.size] = -1
                merge(who, new)

    def _prune(self, p: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Up to ``DEGREE`` diverse neighbours of each p out of ``cand``."""
        g = self.x[cand]
        own = np.maximum(0, self.norm[p][:, None] + self.norm[cand] - 2 * np.einsum("bcd,bd->bc", g, self.x[p]))
        own[(cand < 0) | (cand == p[:, None])] = np.inf
        order = np.argsort(own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, axis=1), np.take_along_axis(own, order, axis=1)
        g = np.take_along_axis(g, order[:, :, None], axis=1)
        norm = self.norm[cand]
        between = np.maximum(0, norm[:, :, None] + norm[:, None, :] - 2 * (g @ g.transpose(0, 2, 1)))
        alive = np.isfinite(own)
        alive[:, 1:] &= cand[:, 1:] != cand[:, :-1]
        out = np.full((len(p), DEGREE), -1, np.int32)
        rows = np.arange(len(p))
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[some, k] = cand[rows, first][some]
            alive &= ~(RELAX * RELAX * between[rows, first] <= own) | ~some[:, None]
            alive[rows, first] = False
        return out

    def _insert(self, end: int) -> None:
        p = np.arange(self.size, end)
        if not self.size:
            self.size = end
            found = np.broadcast_to(p, (end, end)).copy()
        else:
            found, _ = self.search(self.x[p], BUILD_BEAM)
            self.size = end
        out = self._prune(p, found)
        self.edges[p, :DEGREE] = out
        self.degree[p] = (out >= 0).sum(axis=1)
        r, c = np.nonzero(out >= 0)
        to, source = out[r, c].astype(np.int64), p[r]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        first = np.searchsorted(to, to, side="left")
        turn = np.arange(len(to)) - first
        for t in range(int(turn.max(initial=-1)) + 1):  # one reverse edge per target in a turn
            now = turn == t
            u, v = to[now], source[now]
            full = self.degree[u] >= CAPACITY
            if full.any():
                kept = self._prune(u[full], np.concatenate([self.edges[u[full]].astype(np.int64), v[full][:, None]], axis=1))
                self.edges[u[full]] = -1
                self.edges[u[full], :DEGREE] = kept
                self.degree[u[full]] = (kept >= 0).sum(axis=1)
            u, v = u[~full], v[~full]
            have = (self.edges[u] == v[:, None]).any(axis=1)
            u, v = u[~have], v[~have]
            self.edges[u, self.degree[u]] = v
            self.degree[u] += 1


def _floats(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


_FOUND = "qh long, qg long, vec_id {id}, score double"


def _searcher(k: int, id_type: pa.DataType):
    def search(key, nodes: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["qh", "qg", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), id_type, pa.float64()]
        if not nodes.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        dim = key[0].as_py()
        x, q = _floats(nodes["embedding"], dim), _floats(queries["embedding"], dim)
        graph = Graph(x)
        ids = nodes["ids"].to_pylist()
        qh, qg = queries["vh"].to_numpy(), queries["vg"].to_numpy()
        out_q, out_id, out_score = [], [], []
        for i in range(0, len(q), BATCH):
            part = q[i:i + BATCH]
            lifted = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32)
            near, _ = graph.search(lifted, SEARCH_BEAM)
            for r in range(len(part)):
                rows = graph.rows[near[r][near[r] >= 0]]
                score = x[rows] @ part[r]
                left, last = k, None
                for s in np.argsort(-score, kind="stable").tolist():
                    if left <= 0 and score[s] != last:
                        break  # equal scores go on, so that ties can be settled by id
                    last = score[s]
                    for v in ids[rows[s]][:k]:
                        out_q.append(i + r), out_id.append(v), out_score.append(float(score[s]))
                        left -= 1
        return pa.table([pa.array(qh[out_q]), pa.array(qg[out_q]), pa.array(out_id, id_type),
                         pa.array(out_score, pa.float64())], names=names)
    return search


def _usable(v: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0.0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` picks,
    the ``k`` nearest other ids by inner product, ties to the smaller id.

    Defined cases: rows with a null id and vectors that are null, empty, all
    zero or hold a null or non-finite component take no part; repeated rows
    count once; an id with several vectors is a candidate, and a query, with
    each of them; only vectors of one length are compared.  Rows with equal
    vectors are indexed as one node that carries its k + 1 smallest ids, of
    which no query can need more.  Other columns play no part.
    """
    rows = (vectors.withColumn("__q", F.coalesce(is_query, F.lit(False)))
            .select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), "__q")
            .where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
            .withColumns({"vh": F.xxhash64("embedding"), "vg": F.xxhash64(F.lit(1), "embedding")}))
    smallest = Window.partitionBy("vh", "vg").orderBy("vec_id")
    ids = (rows.select("vh", "vg", "vec_id").distinct().withColumn("n", F.row_number().over(smallest))
           .where(F.col("n") <= k + 1).groupBy("vh", "vg").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    distinct = rows.select("vh", "vg", "embedding").dropDuplicates(["vh", "vg"])
    nodes = stage(distinct.join(ids, ["vh", "vg"]).withColumn("dim", F.size("embedding")))
    asked = stage(rows.where("__q").select("vec_id", "vh", "vg").distinct())
    queries = stage(nodes.join(asked.select("vh", "vg").distinct(), ["vh", "vg"], "left_semi").select(
        "vh", "vg", "embedding", "dim"))
    n, m = nodes.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(m / QUERIES))
    dealt = nodes.select("dim", F.pmod("vh", F.lit(shards)).alias("shard"), "embedding", "ids",
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = queries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"),
                          F.pmod("vg", F.lit(blocks)).cast("int").alias("block"), "vh", "vg", "embedding")
    id_type = dict(rows.dtypes)["vec_id"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
    keys = ["dim", "shard", "block"]
    found = (dealt.groupBy(*keys).cogroup(sent.groupBy(*keys))
             .applyInArrow(_searcher(k + 1, arrow), _FOUND.format(id=id_type)))
    best = Window.partitionBy("qh", "qg").orderBy(F.desc("score"), "vec_id")
    merged = stage(found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    own = asked.toDF("query_id", "qh", "qg")
    per = Window.partitionBy("query_id", "qh", "qg").orderBy(F.desc("score"), "vec_id")
    return (merged.join(own, ["qh", "qg"]).where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

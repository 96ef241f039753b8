"""Exact nearest-vector search that skips files.

An index is a table of unit vectors partitioned by their nearest coarse centre;
all vectors of a centre and corpus form a ball with a radius (the widest angle
to the centre).  No vector of a ball can be closer to a query than the ball's
rim, so a query visits balls in the order of that bound and ends once its k-th
score beats the next one: files of balls that no query needs are not read, and
the answer is that of a full search.

Queries come in blocks of bounded size.  A block's balls are visited in rounds
that double, each one job over the folders needed; per round only rows that the
k-th score so far does not rule out are kept, and the best k of a query and
corpus come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators import clustering as cl
from tessera.operators.vectors import DECIMALS, MAX_SCORE_CELLS, _best, _unit
from tessera.session import stage_path

#: Coarse centres at most; bytes of one block's query vectors, and its queries x balls at most.
CELLS, BLOCK_BYTES, BLOCK_BOUNDS = 1024, 32 << 20, 8_000_000
#: Bounds are widened by this much, well above rounding errors and far below what matters.
SLACK = 1e-9
#: Tasks that write one cell, so that a cell with many vectors is not one task.
WRITERS = 8
#: Rows found by a task that wait at least until they are merged with its best so far.
MERGE_ROWS = 1 << 17
_ZERO = -1


@dataclass
class BallIndex:
    """Where the vectors lie, and one row per ball: cell, corpus, number of
    vectors, unit centre and least cosine to it."""
    path: str
    schema: T.StructType
    width: int
    cell: np.ndarray
    corpus: list
    n: np.ndarray
    centre: np.ndarray
    least: np.ndarray


def _unit_column(width: int):
    @F.arrow_udf("array<double>")
    def unit(v: pa.Array) -> pa.Array:
        x = _unit(v, width)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(x.ravel()))
    return unit


def build(corpus: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", corpus_col: str = "corpus",
          width: int = 384, cells: int | None = None, carry: list[str] | None = None) -> BallIndex:
    """Write an index of ``corpus`` under ``path`` and open it.

    Rows without id or vector are left out; a zero vector, one of another width
    or one with a null or non-finite number is kept as the zero vector, in a
    ball of its own.  The number of centres is about the root of the number of
    vectors, at most ``CELLS``."""
    spark = corpus.sparkSession
    kept = corpus.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(corpus_col).alias("corpus"), _unit_column(width)(F.col(vec_col).cast("array<double>")).alias("vec"),
        *(carry or []))
    flat = stage_path(spark, "units")
    kept.write.parquet(flat)
    units = spark.read.schema(kept.schema).parquet(flat)
    whole = units.where(F.exists("vec", lambda x: x != 0))
    k = cells or min(CELLS, int(whole.count() ** 0.5) + 1)
    centres, _ = cl.minibatch_centres(whole, "id", "vec", width, k, seeds=(42,))
    norms = np.linalg.norm(centres, axis=1) if len(centres) else np.zeros(0)
    centres = centres / np.where(norms == 0, 1.0, norms)[:, None] if len(centres) else centres
    shared = spark.sparkContext.broadcast(centres)

    @F.arrow_udf("struct<cell: int, near: double>")
    def place(v: pa.Array) -> pa.Array:
        x, c = cl.matrix(v, width), shared.value
        cell, near = np.full(len(x), _ZERO, np.int32), np.zeros(len(x))
        full = np.flatnonzero(x.any(1))
        if len(full):
            cell[full] = cl.nearest(x[full], c)[0]
            near[full] = np.einsum("ij,ij->i", x[full], c[cell[full]])
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(near)], ["cell", "near"])

    placed = units.withColumn("at", place(F.col("vec"))).select("*", F.col("at.cell").alias("cell"), F.col("at.near").alias("near")).drop("at")
    spread = F.pmod(F.xxhash64("id"), F.lit(WRITERS))
    placed.repartition(F.col("cell"), spread).write.partitionBy("cell").parquet(f"{path}/vectors")
    spark.createDataFrame([], placed.schema).write.parquet(f"{path}/schema")  # an empty partitioned table has no file to tell it
    rows = spark.read.schema(placed.schema).parquet(f"{path}/vectors").groupBy("cell", "corpus").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("least"))
    centre = {_ZERO: [0.0] * width} | {i: c.tolist() for i, c in enumerate(centres)}
    table = spark.createDataFrame(list(centre.items()), "cell int, centre array<double>")
    rows.join(table, "cell").write.parquet(f"{path}/balls")
    return open_index(spark, path, width)


def open_index(spark: SparkSession, path: str, width: int) -> BallIndex:
    """An index written before; its balls (centres x corpora) are read."""
    balls = spark.read.parquet(f"{path}/balls").orderBy("cell", "corpus").toArrow()
    schema = spark.read.parquet(f"{path}/schema").schema
    centre = np.array(balls["centre"].to_pylist(), float).reshape(-1, width)
    return BallIndex(path, schema, width, balls["cell"].to_numpy(), balls["corpus"].to_pylist(), balls["n"].to_numpy(), centre,
                     balls["least"].to_numpy())


def _bounds(index: BallIndex, q: np.ndarray) -> np.ndarray:
    """No vector of a ball scores more against a query: queries x balls."""
    angle = np.arccos(np.clip(q @ index.centre.T, -1, 1)) - np.arccos(np.clip(index.least, -1, 1))[None, :]
    bound = np.cos(np.maximum(angle, 0.0)) + SLACK
    flat = np.ones_like(bound, dtype=bool) & ((index.cell == _ZERO)[None, :] | ~q.any(1)[:, None])
    return np.where(flat, SLACK, bound)


def _visitor(shared, k: int, width: int, decimals: int):
    """mapInArrow body: the best k rows of every query and corpus among the
    balls that the query visits in this round, as far as they reach its k-th
    score so far.  A ball adds few rows to many queries, so that rows wait and
    are merged together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, visits = shared.value
        state: dict = {}
        waiting: dict = {}

        def merge(corpus):
            parts = ([state[corpus]] if corpus in state else []) + waiting.pop(corpus)
            col, score = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
            held = pa.concat_tables([part[2] for part in parts]).combine_chunks()
            keep = _best(col, score, held.column("id"), k, len(q))
            state[corpus] = (col[keep], score[keep], held.take(pa.array(keep)))

        for batch in batches:
            table = pa.Table.from_batches([batch]).drop_columns(["vec", "cell"])
            x = cl.matrix(batch.column("vec"), width)
            key = pa.array([f"{c}\0{n}" if n is not None else f"{c}" for c, n in zip(batch.column("cell").to_pylist(), batch.column("corpus").to_pylist())])
            codes = key.dictionary_encode()
            for code, name in enumerate(codes.dictionary.to_pylist()):
                if name not in visits:
                    continue
                asked, kth_so_far = visits[name]
                rows = np.flatnonzero(codes.indices.to_numpy() == code)
                corpus = batch.column("corpus")[int(rows[0])].as_py()
                step = max(1, MAX_SCORE_CELLS // len(rows))
                for a in range(0, len(asked), step):
                    sims = np.round(x[rows] @ q[asked[a:a + step]].T, decimals)
                    least = kth_so_far[a:a + step]
                    reach = sims >= least[None, :]
                    if np.count_nonzero(reach) > k * reach.shape[1] and len(rows) > k:
                        reach &= sims >= np.partition(sims, len(rows) - k, axis=0)[len(rows) - k][None, :]
                    r, c = np.nonzero(reach)
                    if not len(r):
                        continue
                    waiting.setdefault(corpus, []).append((asked[a:a + step][c], sims[r, c], table.take(pa.array(rows[r]))))
                    if sum(len(part[0]) for part in waiting[corpus]) > max(MERGE_ROWS, len(state[corpus][0]) if corpus in state else 0):
                        merge(corpus)
        for corpus in list(waiting):
            merge(corpus)
        for col, score, held in state.values():
            yield from held.append_column("q", pa.array(col, pa.int64())).append_column("cosine", pa.array(score)).combine_chunks().to_batches()
    return run


def _top(table: pa.Table, k: int) -> pa.Table:
    """The best k of each query and corpus, ties by smaller id, ranked."""
    if not table.num_rows:
        return table.append_column("rank", pa.array([], pa.int32()))
    corpus = table["corpus"].combine_chunks().dictionary_encode(null_encoding="encode")
    corpus = corpus.combine_chunks() if isinstance(corpus, pa.ChunkedArray) else corpus
    group = table["q"].to_numpy() * (len(corpus.dictionary) + 1) + corpus.indices.to_numpy(zero_copy_only=False)
    by_id = pc.rank(table["id"], sort_keys="ascending", tiebreaker="first").to_numpy()
    order = np.lexsort((by_id, -table["cosine"].to_numpy(), group))
    ordered = group[order]
    first = np.searchsorted(ordered, ordered)
    rank = np.arange(len(order)) - first
    keep = rank < k
    return table.take(pa.array(order[keep])).append_column("rank", pa.array((rank[keep] + 1).astype(np.int32)))


def search(index: BallIndex, queries: DataFrame, k: int = 3, query_id_col: str = "query_id", vec_col: str = "embedding",
           decimals: int = DECIMALS) -> tuple[DataFrame, dict]:
    """The exact top ``k`` per (query, corpus): (query_id, corpus, rank, id,
    cosine, similarity, carried columns), as ``vectors.similarity_topk`` gives
    them, and a report: blocks, rounds, vectors read and vectors of a full
    search.  Any number of queries; one without an id raises ``ValueError``."""
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id_col).alias("query_id"), _unit_column(index.width)(F.col(vec_col).cast("array<double>")).alias("vec"))
    if not asked.where("query_id IS NULL").isEmpty():
        raise ValueError("a query has no id")
    size = min(BLOCK_BYTES // (8 * index.width), BLOCK_BOUNDS // max(len(index.n), 1)) + 1
    blocks = asked.count() // size + 1
    staged = stage_path(spark, "queries")
    asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(staged)
    fields = [f for f in index.schema.fields if f.name not in ("vec", "cell", "near")]
    id_type = asked.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), *fields, T.StructField("cosine", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    report = {"blocks": blocks, "rounds": 0, "read": 0, "full": int(index.n.sum()) * blocks}
    parts = []
    rows = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("block", T.IntegerType())])).parquet(staged)
    # Its files are listed once, not for every round.
    vectors = spark.read.schema(index.schema).parquet(f"{index.path}/vectors")
    for b in range(blocks):
        block = rows.where(F.col("block") == b).select("query_id", "vec").toArrow().combine_chunks()  # about ``size`` rows
        if not block.num_rows:
            continue
        hits = _search_block(spark, index, vectors, _unit(_chunk(block["vec"]), index.width), k, fields, decimals, report)
        ids = _chunk(block["query_id"]).take(hits["q"].combine_chunks())
        out = stage_path(spark, "hits")
        spark.createDataFrame(hits.drop_columns(["q"]).add_column(0, "query_id", ids), schema).write.parquet(out)
        parts.append(out)
    found = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    carried = [f.name for f in fields if f.name not in ("id", "corpus")]
    sim = (F.col("cosine") + 1) / 2
    return found.select("query_id", "corpus", "rank", "id", "cosine", sim.alias("similarity"), *carried).where(F.col("similarity") != 0), report


def _chunk(column) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _search_block(spark, index: BallIndex, vectors: DataFrame, q: np.ndarray, k: int, fields: list, decimals: int, report: dict) -> pa.Table:
    bound = _bounds(index, q)
    names = sorted({str(c) for c in index.corpus if c is not None})
    number = np.array([names.index(str(c)) if c is not None else len(names) for c in index.corpus])
    kth = np.full((len(q), len(names) + 1), -np.inf)
    seen = np.zeros_like(bound, dtype=bool)
    hit_schema = T.StructType([*fields, T.StructField("q", T.LongType()), T.StructField("cosine", T.DoubleType())])
    best, count = None, 1
    while True:
        need = np.zeros_like(seen)
        for c in range(len(names) + 1):
            balls = np.flatnonzero(number == c)
            # Balls that may still hold one of the best k, the most promising first.
            open_ = np.where(~seen[:, balls] & (bound[:, balls] >= kth[:, [c]]), bound[:, balls], -np.inf)
            order = np.argsort(-open_, axis=1, kind="stable")[:, :count]
            pick = np.take_along_axis(open_, order, 1) > -np.inf
            need[np.repeat(np.arange(len(q)), pick.sum(1)), balls[order[pick]]] = True
        used = np.flatnonzero(need.any(0))
        if not len(used):
            return _top(best.drop_columns(["rank"]), k) if best is not None else _top(_empty(spark, hit_schema), k)
        seen |= need
        report["rounds"] += 1
        report["read"] += int(index.n[np.isin(index.cell, index.cell[used])].sum())
        visits = {}
        for u in used:
            asked = np.flatnonzero(need[:, u])
            visits[f"{index.cell[u]}\0{index.corpus[u]}" if index.corpus[u] is not None else f"{index.cell[u]}"] = asked, kth[asked, number[u]]
        shared = spark.sparkContext.broadcast((q, visits))
        rows = vectors.where(F.col("cell").isin([int(c) for c in np.unique(index.cell[used])])).drop("near")
        found = rows.select(*[f.name for f in fields], "vec", "cell").mapInArrow(_visitor(shared, k, index.width, decimals), hit_schema)
        w = Window.partitionBy("q", "corpus").orderBy(F.desc("cosine"), "id")
        got = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r").toArrow()  # queries x corpora x k rows
        shared.unpersist()
        best = _top(got if best is None else pa.concat_tables([best.drop_columns(["rank"]), got.cast(best.drop_columns(["rank"]).schema)]), k)
        full = best.filter(pc.equal(best["rank"], k))
        at = np.array([names.index(str(c)) if c is not None else len(names) for c in full["corpus"].to_pylist()], int)
        kth[full["q"].to_numpy(), at] = full["cosine"].to_numpy()
        count *= 2


def _empty(spark, schema: T.StructType) -> pa.Table:
    return spark.createDataFrame([], schema).toArrow()

"""Vector operators: cluster sizes and centroids, theme filtering, and exact
top-k similarity search.

Similarity search never materialises query x corpus pairs: a block of queries,
bounded by ``BLOCK_BYTES``, is broadcast, every corpus partition scores its
Arrow batches with one matrix product and keeps only its own top-k per
(query, corpus), and a final ``row_number`` over those few candidates picks
the global top-k.  Shuffle volume is partitions x queries x k rows, whatever
the corpus size.  More queries are further blocks, searched one after another
(``ball_index`` answers many queries without reading the whole corpus for each
block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.functions import vectors as vf
from tessera.operators.filters import keep_keys
from tessera.schemas import EMBEDDING_WIDTH
from tessera.session import write_stage

#: Bytes of the query vectors that are broadcast at a time.
BLOCK_BYTES = 64 << 20
#: Scores are compared at this many decimals, so that equal vectors tie
#: whatever batch they stand in.
DECIMALS = 12


def cluster_sizes(df: DataFrame, cluster_col: str) -> DataFrame:
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))


def centroids(df: DataFrame, cluster_col: str, vec_col: str) -> DataFrame:
    """Element-wise mean vector per cluster (array<double>) and cluster size.

    ``Summarizer.mean`` is a JVM aggregate with partial merge: each task
    folds its rows into one running vector per cluster before the shuffle.
    """
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    g = df.groupBy(cluster_col).agg(Summarizer.mean(v).alias("_m"), F.count(F.lit(1)).alias("n"))
    return g.select(cluster_col, vector_to_array("_m").alias("centroid"), "n")


def mean_vector(df: DataFrame, vec_col: str) -> list[float]:
    """Mean of all vectors, fetched as one bounded row (a theme/query vector)."""
    v = array_to_vector(F.col(vec_col).cast("array<double>"))
    row = df.agg(vector_to_array(Summarizer.mean(v)).alias("m")).first()
    return list(row["m"]) if row and row["m"] is not None else []


def _lit_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def rank_by_theme(cents: DataFrame, cluster_col: str, theme: list[float],
                  threshold: float = 0.5) -> DataFrame:
    """Clusters ranked by cosine(centroid, theme), descending (ties by id);
    ``selected`` marks those at or above ``threshold``.  Works on one row per
    cluster; the number of clusters is the ``k`` of the clustering."""
    sim = vf.cosine(F.col("centroid"), _lit_vector(theme))
    s = cents.select(cluster_col, "n", sim.alias("sim"))
    w = Window.orderBy(F.desc("sim"), F.asc(cluster_col))
    return s.select(cluster_col, "n", "sim", F.row_number().over(w).alias("rank"),
                    (F.col("sim") >= threshold).alias("selected"))


def theme_filter(df: DataFrame, cluster_col: str, vec_col: str, theme: list[float],
                 threshold: float = 0.5) -> DataFrame:
    """Rows of clusters whose centroid is at least ``threshold`` similar to
    the theme (left semi join against the selected cluster ids)."""
    ranked = rank_by_theme(centroids(df, cluster_col, vec_col), cluster_col, theme, threshold)
    return keep_keys(df, ranked.where("selected"), cluster_col)


# Scores held at once per task: batch rows x queries (doubles), ~128 MB.
MAX_SCORE_CELLS = 16_000_000


def _unit(rows: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of a list column; null, wrong-width and zero vectors, and
    such with a null or non-finite component, are zero."""
    out = np.zeros((len(rows), width))
    if not len(rows):
        return out
    ok = pc.fill_null(pc.equal(pc.list_value_length(rows), width), False)
    at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    if len(at):
        out[at] = rows.filter(ok).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    out[~np.isfinite(out).all(axis=1)] = 0.0
    norms = np.linalg.norm(out, axis=1)
    return out / np.where(norms == 0, 1.0, norms)[:, None]


def _best(col: np.ndarray, score: np.ndarray, ids: pa.Array, k: int, n_cols: int) -> np.ndarray:
    """Indices of the best k entries per query column: by score descending,
    ties by smaller id (one lexsort for all queries)."""
    by_id = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy()
    order = np.lexsort((by_id, -score, col))
    sorted_col = col[order]
    starts = np.searchsorted(sorted_col, np.arange(n_cols))
    return order[np.arange(len(order)) - starts[sorted_col] < k]


def _scorer(block, k: int, width: int, decimals: int):
    """mapInArrow body: per partition keep the best k per (query, corpus).

    Each Arrow batch is scored against at most ``MAX_SCORE_CELLS / rows``
    queries at a time (bounded memory per task).  Per query the k-th best
    score is found with ``np.partition``; every row at or above it (ties
    included) is a candidate, and one lexsort over (query, -score, id) keeps
    the exact top k per query, also when merging with earlier batches.  Ids
    and carried columns stay Arrow columns of their own type throughout; the
    corpus rows are held by position.  ``block`` is a broadcast variable with
    (query ids, unit query matrix): shipped once per executor, not per task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qmat = block.value
        n_q = len(qids)
        state: dict = {}  # corpus -> (query column, score, rows as a table)
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column("vec"), width)
            table = pa.Table.from_batches([batch]).drop_columns(["vec"])
            names = batch.column("corpus").dictionary_encode(null_encoding="encode")
            codes = names.indices.to_numpy(zero_copy_only=False)
            step = max(1, MAX_SCORE_CELLS // batch.num_rows)
            for code, name in enumerate(names.dictionary.to_pylist()):
                rows = np.flatnonzero(codes == code)
                for q0 in range(0, n_q, step):
                    sims = np.round(unit[rows] @ qmat[q0:q0 + step].T, decimals)
                    if len(rows) > k:
                        kth = np.partition(sims, len(rows) - k, axis=0)[len(rows) - k]
                        r, c = np.nonzero(sims >= kth[None, :])
                    else:
                        r, c = np.nonzero(np.ones_like(sims, dtype=bool))
                    col, score, held = c + q0, sims[r, c], table.take(pa.array(rows[r]))
                    if name in state:
                        old = state[name]
                        col, score = np.concatenate([old[0], col]), np.concatenate([old[1], score])
                        held = pa.concat_tables([old[2], held]).combine_chunks()
                    keep = _best(col, score, held.column("id"), k, n_q)
                    state[name] = (col[keep], score[keep], held.take(pa.array(keep)))
        for col, score, held in state.values():
            out = held.append_column("query_id", qids.take(pa.array(col))).append_column("cosine", pa.array(score))
            yield from out.combine_chunks().to_batches()
    return run


def similarity_topk(corpus: DataFrame, queries: DataFrame, k: int = 3, *, id_col: str = "id",
                    vec_col: str = "embedding", corpus_col: str = "corpus",
                    query_id_col: str = "query_id", query_vec_col: str = "embedding",
                    width: int | None = None, block_bytes: int = BLOCK_BYTES,
                    carry: list[str] | None = None, decimals: int = DECIMALS) -> DataFrame:
    """Exact top-``k`` corpus rows per (query, corpus) by cosine similarity.

    Returns (query_id, corpus, rank, id, cosine, similarity) where
    ``similarity = (cosine + 1) / 2``; rows whose similarity is exactly 0 are
    dropped after ranking (so fewer than k may come back).  Ids of queries and
    rows may be of any type and keep it.  Rows without a vector or an id are
    skipped; a wrong-width vector counts as the zero vector (similarity 0.5);
    rows with a null corpus form a corpus of their own.  Ties rank the smaller
    id first.  A query without an id raises ``ValueError``.  Any number of
    queries is answered, in blocks of about ``block_bytes``.  Scores are compared at ``decimals``.  ``carry`` names corpus columns returned with each
    hit (so the corpus is read once).
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = corpus.sparkSession
    carry = list(carry or [])
    asked = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).cast("array<double>").alias("vec"))
    some = max(1, block_bytes // (8 * (width or EMBEDDING_WIDTH)))
    rows = asked.limit(some + 1).toArrow()
    if rows.num_rows > some or rows["vec"].nbytes > 2 * block_bytes:
        known = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).first()
        width = width or known["w"] or 1
        blocks = known["n"] * width * 8 // block_bytes + 1
        path = write_stage(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).repartition("block"), "queries", ["block"])
        every = spark.read.schema(T.StructType([*asked.schema.fields, T.StructField("block", T.IntegerType())])).parquet(path)
        found = [write_stage(_search(corpus, every.where(F.col("block") == b).select("query_id", "vec").toArrow(), asked, k, id_col, vec_col,
                                     corpus_col, width, carry, decimals), "hits") for b in range(blocks)]
        return spark.read.parquet(*found)
    return _search(corpus, rows, asked, k, id_col, vec_col, corpus_col, width, carry, decimals)


def _search(corpus: DataFrame, rows: pa.Table, queries: DataFrame, k: int, id_col: str, vec_col: str, corpus_col: str,
            width: int | None, carry: list[str], decimals: int) -> DataFrame:
    """The search for one block of queries, held by the driver."""
    spark = corpus.sparkSession
    if rows["query_id"].null_count:
        raise ValueError("a query has no id")
    vecs = rows["vec"].combine_chunks()
    if isinstance(vecs, pa.ChunkedArray):
        vecs = pa.concat_arrays(vecs.chunks) if vecs.num_chunks else pa.array([], pa.list_(pa.float64()))
    if width is None:
        width = max([w for w in pc.list_value_length(vecs).to_pylist() if w], default=1)
    ids = rows["query_id"].combine_chunks()
    ids = ids if not isinstance(ids, pa.ChunkedArray) else pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array(
        [], ids.type)
    shared = spark.sparkContext.broadcast((ids, _unit(vecs, width)))
    c = corpus.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(corpus_col).alias("corpus"),
        F.col(vec_col).cast("array<double>").alias("vec"), *carry)
    fields = [f for f in c.schema.fields if f.name != "vec"]
    schema = T.StructType([*fields, T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("cosine", T.DoubleType())])
    cand = c.mapInArrow(_scorer(shared, k, width, decimals), schema)
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc("cosine"), F.asc("id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    sim = (F.col("cosine") + 1) / 2
    return top.select("query_id", "corpus", "rank", "id", "cosine", sim.alias("similarity"), *carry) \
              .where(F.col("similarity") != 0)


def check_search_params(text: str | None, top_k: int, min_chars: int = 50, max_k: int = 50) -> None:
    """Validate a search request: non-blank text of at least ``min_chars``
    characters and ``1 <= top_k <= max_k``; raises ``ValueError``."""
    if text is None or not text.strip():
        raise ValueError("query text is empty")
    if len(text.strip()) < min_chars:
        raise ValueError(f"query text must have at least {min_chars} characters")
    if not isinstance(top_k, int) or isinstance(top_k, bool) or not 1 <= top_k <= max_k:
        raise ValueError(f"top_k must be an integer in 1..{max_k}")

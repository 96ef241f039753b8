"""Model stages: embeddings, PCA + k-means, bag of words.

Fits are actions; their inputs are staged as Parquet under the checkpoint
folder first, so an iterative fit re-reads a short lineage after an
executor loss.  Inference outside the JVM goes through
``predict_batch_udf`` (Arrow batches, model built once per worker).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (IDF, PCA, CountVectorizerModel, HashingTF, Normalizer,
                                RegexTokenizer, StopWordsRemover)
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.functions import vectors as vf
from tessera.operators import clustering, labels
from tessera.schemas import EMBEDDING_WIDTH
from tessera.session import stage_table

TOKEN_PATTERN = r"(?U)\b\w\w+\b"
#: The same matches, found without looking at both sides of every character.
_TOKEN_RUNS = r"(?U)\w{2,}"
TEXT = "_text"


# -- embeddings --------------------------------------------------------------

def fit_tfidf(df: DataFrame, text_col: str, width: int = EMBEDDING_WIDTH) -> PipelineModel:
    """JVM encoder fitted on a corpus: tokens -> hashed term counts (``width``
    buckets) -> IDF -> L2 normalisation.  The model encodes corpus and queries
    alike (``encode``)."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=TEXT, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=width),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_vec", p=2.0),
    ]).fit(df.select(F.coalesce(text_col, F.lit("")).alias(TEXT)))


def fit_vocabulary_tfidf(df: DataFrame, text_col: str, id_col: str, stop_words: list[str] | None = None,
                         max_terms: int = 500, min_df: int = 3, max_df: float = 0.5) -> PipelineModel:
    """Encoder over the corpus vocabulary (one dimension per term, at most
    ``max_terms``): count x ln((N + 1) / (docs + 1)), L2 normalised."""
    vocab = [r["term"] for r in vocabulary(df, id_col, text_col, stop_words, max_terms, min_df,
                                           max_df).collect()]  # at most max_terms
    texts = df.select(F.coalesce(text_col, F.lit("")).alias(TEXT))
    tok = RegexTokenizer(inputCol=TEXT, outputCol="_tok", pattern=TOKEN_PATTERN, gaps=False)
    count = CountVectorizerModel.from_vocabulary(vocab, inputCol="_tok", outputCol="_tf")
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(count.transform(tok.transform(texts)))
    return PipelineModel([tok, count, idf, Normalizer(inputCol="_idf", outputCol="_vec", p=2.0)])


def encode(model: PipelineModel, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
    """``df`` with the vectors (``array<double>``) of a fitted encoder; null
    text counts as empty and gets the zero vector."""
    made = model.transform(df.withColumn(TEXT, F.coalesce(text_col, F.lit(""))))
    return made.withColumn(out, vector_to_array("_vec")).drop(TEXT, "_tok", "_tf", "_idf", "_vec")


def embed_tfidf(df: DataFrame, text_col: str, width: int = EMBEDDING_WIDTH,
                out: str = "embedding") -> DataFrame:
    """Fit on ``df`` and encode it."""
    return encode(fit_tfidf(df, text_col, width), df, text_col, out)


def embed_batches(df: DataFrame, text_col: str, make_predict_fn: Callable, width: int,
                  batch_size: int = 64, out: str = "embedding") -> DataFrame:
    """Caller-supplied encoder over Arrow batches of ``batch_size`` texts.

    ``make_predict_fn()`` returns ``fn(texts: np.ndarray) -> np.ndarray``
    shaped (n, width); it runs once per Python worker, so a model is loaded
    once, not per row.
    """
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


def batch_scores(df: DataFrame, text_col: str, make_predict_fn: Callable, names: list[str],
                 batch_size: int = 32, out: str = "scores") -> DataFrame:
    """A caller's classifier over Arrow batches: ``make_predict_fn()`` returns
    ``fn(texts: np.ndarray) -> np.ndarray`` shaped (n, len(names)) and runs
    once per Python worker.  Adds ``out``, an array of scores in the order of
    ``names``; rows without text get null scores and are not scored."""
    if not names:
        raise ValueError("at least one label is required")
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn(out, F.when(F.col(text_col).isNotNull(), udf(text)))


def chunked_scores(df: DataFrame, id_col: str, text_col: str, make_predict_fn: Callable, names: list[str],
                   size: int = 300, batch_size: int = 32) -> DataFrame:
    """(id, chunk_no, label, score): the classifier's top label for every chunk
    of ``size`` words of every text (first label on ties)."""
    chunks = df.select(id_col, F.posexplode(tx.chunk_words(text_col, size)).alias("chunk_no", "ws"))
    scored = batch_scores(chunks.select(id_col, "chunk_no", F.array_join("ws", " ").alias("chunk")), "chunk",
                          make_predict_fn, names, batch_size)
    best = labels.top_label(F.col("scores"), names, threshold=float("-inf"))
    return scored.select(id_col, "chunk_no", best.alias("b")).select(
        id_col, "chunk_no", F.col("b.label").alias("label"), F.col("b.score").alias("score"))


def hashing_encoder(width: int = EMBEDDING_WIDTH, n: int = 3) -> Callable:
    """A small deterministic stand-in encoder for tests and offline runs:
    hashed byte n-gram counts of the lower-cased UTF-8 text, L2 normalised
    (numpy per text, no per-character Python loop)."""
    def make():
        weights = np.array([1_000_003 ** (n - 1 - j) % 2_147_483_647 for j in range(n)], dtype=np.int64)

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width), dtype=np.float32)
            for i, t in enumerate(texts):
                b = np.frombuffer((t or "").lower().encode("utf-8"), dtype=np.uint8).astype(np.int64)
                if len(b) < n:
                    continue
                grams = sum(b[j:len(b) - n + 1 + j] * weights[j] for j in range(n))
                out[i] = np.bincount(grams % width, minlength=width)
                out[i] /= np.linalg.norm(out[i])
            return out
        return predict
    return make


# -- clustering ----------------------------------------------------------------

def reduce_vectors(df: DataFrame, vec_col: str, id_col: str, width: int, dims: int = 50) -> DataFrame:
    """(id, _p): vectors reduced to ``dims`` principal components, staged."""
    vec = F.col(vec_col).cast("array<double>")
    usable = (F.size(vec) == width) & F.forall(vec, lambda x: x.isNotNull())
    v = df.where(usable).select(id_col, array_to_vector(vec).alias("_v"))
    reduced = PCA(k=min(dims, width), inputCol="_v", outputCol="_p").fit(v).transform(v).select(id_col, "_p")
    return stage_table(reduced, "pca")


def pca_kmeans(df: DataFrame, vec_col: str, id_col: str, width: int, k: int = 10, dims: int = 50,
               seeds: tuple[int, ...] = (42, 43, 44)) -> DataFrame:
    """Reduce to ``dims`` with PCA, then k-means with several seeds, keeping
    the fit with the lowest training cost; returns (id, cluster).  Rows whose
    vector is null, not ``width`` long or holds a null are left out."""
    reduced = reduce_vectors(df, vec_col, id_col, width, dims)
    best = None
    for s in seeds:
        m = KMeans(k=k, seed=s, featuresCol="_p", predictionCol="cluster", maxIter=50).fit(reduced)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1].transform(reduced).select(id_col, "cluster")


def pca_minibatch(df: DataFrame, vec_col: str, id_col: str, width: int, k: int = 10, dims: int = 50,
                  seeds: tuple[int, ...] = (42, 43, 44)) -> tuple[DataFrame, np.ndarray, float]:
    """``pca_kmeans`` by mini-batches: ((id, reduced, cluster), centres, cost).
    Most steps read one slice of the table, so the fit reads it a few times
    where the full one reads it up to 50 times for each seed."""
    dims = min(dims, width)
    reduced = reduce_vectors(df, vec_col, id_col, width, dims).select(id_col, vector_to_array("_p").alias("reduced"))
    centres, cost = clustering.minibatch_centres(reduced, id_col, "reduced", dims, k, seeds)
    return clustering.assign(reduced, "reduced", centres), centres, cost


# -- bag of words and topics ---------------------------------------------------

def tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased word tokens of two or more characters, stop words removed."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN_RUNS), 0)
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(stop_words))
    return toks


#: Tokens whose terms are counted at once, in whole documents.
COUNT_TOKENS = 1 << 20


def _term_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n, docs) of some documents at a time, from a column of their tokens."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = begin = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, begin + COUNT_TOKENS, side="right")))
            found = batch.column(0).slice(at, end - at).flatten().dictionary_encode()
            code = found.indices.to_numpy().astype(np.int64)
            # Sorted pairs of term and document: a term is in as many documents as it has distinct pairs.
            pair = np.sort(code * (end - at) + np.repeat(np.arange(end - at), np.diff(ends[at:end], prepend=begin)))
            own = pair[np.flatnonzero(np.diff(pair, prepend=-1))] // (end - at)
            yield pa.RecordBatch.from_arrays([found.dictionary, *(pa.array(np.bincount(c, minlength=len(found.dictionary))) for c in (code, own))],
                                             ["term", "n", "docs"])
            at, begin = end, ends[end - 1]


def vocabulary(df: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None = None,
               max_terms: int = 500, min_df: int = 3, max_df: float = 0.5) -> DataFrame:
    """Vocabulary as the bag-of-words vectoriser builds it: terms in at least
    ``min_df`` documents and at most ``max_df`` of them, the ``max_terms``
    most frequent (ties by term).  Returns (term, n, docs)."""
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    n_docs = df.count()
    # Most terms are counted where they lie: only one row per term and some documents is aggregated by Spark.
    ts = df.select(tokens(F.col(text_col)).alias("ts"))
    rows = ts.mapInArrow(_term_numbers, "term string, n long, docs long")
    g = rows.where(~F.col("term").isin(stop_words)).groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    keep = g.where((F.col("docs") >= min_df) & (F.col("docs") <= F.lit(max_df * n_docs)))
    return keep.orderBy(F.desc("n"), F.asc("term")).limit(max_terms)


def term_counts(df: DataFrame, text_col: str, vocab: list[str], stop_words: list[str] | None,
                out: str = "features") -> DataFrame:
    """``df`` with sparse vectors of how often each term of ``vocab`` occurs;
    stop words count as absent (those outside ``vocab`` are never counted)."""
    model = CountVectorizerModel.from_vocabulary(vocab, inputCol="_tok", outputCol=out)
    stop_words = sorted({*vocab}.intersection(stop_words or []))
    return model.transform(df.withColumn("_tok", tokens(F.col(text_col), stop_words))).drop("_tok")

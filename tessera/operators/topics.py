"""Topics of a corpus: latent Dirichlet allocation by batch variational Bayes.

Every iteration reads all documents: tasks fit each document's topic shares to
the current topics and add up, per term, how often each topic explains it; one
aggregation per term replaces the topics by these sums.  The evidence bound,
which never falls, ends the fit once a word gains too little from it.

Topics are at most ``k`` x ``max_terms`` numbers, so they are broadcast and the
sums are fetched; documents stay where they are, spread evenly over the tasks.
A document holds few of the terms, so it is fitted to these alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.models import term_counts, vocabulary
from tessera.session import stage_table

#: Rounds of fitting one document, the change at which they end, and documents x terms x topics fitted at once.
DOC_ROUNDS, DOC_CHANGE, FIT_CELLS = 100, 1e-3, 1 << 19
#: Slices of the corpus for each core, of about as many documents.
SLICES = 2
_TINY = 1e-100


def _six_steps(x: np.ndarray) -> np.ndarray:
    """x (x + 1) ... (x + 5), from the pairs (x + i) (x + 5 - i)."""
    y = x * (x + 5)
    return y * (y + 4) * (y + 6)


def _below_log(x: np.ndarray) -> np.ndarray:
    """log(x + 6) - digamma(x): six steps of the recurrence, as one fraction, and the asymptotic series."""
    y, z = x * (x + 5), x + 6
    r = 1 / (z * z)
    return ((2 * x + 5) * ((3 * y + 20) * y + 24) / _six_steps(x) + 0.5 / z
            + r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma."""
    return np.log(x + 6) - _below_log(x)


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)), without a logarithm."""
    return (x + 6) * np.exp(-_below_log(x))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma: six steps of the recurrence, then Stirling's series."""
    z = x + 6
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - np.log(_six_steps(x))


def _log_shares(dirichlet: np.ndarray) -> np.ndarray:
    """Expected logarithms of the shares under Dirichlet rows."""
    return digamma(dirichlet) - digamma(dirichlet.sum(1))[:, None]


def fit_documents(terms: np.ndarray, counts: np.ndarray, topics: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(gamma, exp expected log shares) of documents under ``topics`` (exp of
    the expected log term shares, k x terms); a row of ``terms`` and ``counts``
    is a document, filled up with counts of zero."""
    k = len(topics)
    now = np.full((len(counts), k), alpha) + counts.sum(1)[:, None] / k
    gamma, mean = np.empty_like(now), np.full(k, 1 / k)
    # Documents in work, some of which may have ended; these are left out once they are many.
    at, open_ = np.arange(len(counts)), np.ones(len(counts), bool)
    weight = topics[:, terms].transpose(1, 0, 2).copy()
    for left in reversed(range(DOC_ROUNDS)):
        theta = exp_digamma(now)  # shares but for a factor of the document, which cancels
        part = counts / (np.matmul(theta[:, None, :], weight)[:, 0] + _TINY)
        new = alpha + theta * np.matmul(weight, part[:, :, None])[:, :, 0]
        ended = np.flatnonzero(open_ & ~(np.abs(new - now) @ mean > DOC_CHANGE) if left else open_)
        now = new
        if len(ended):
            gamma[at[ended]], open_[ended] = now[ended], False
            n = np.count_nonzero(open_)
            if not n:
                break
            if n < 0.75 * len(at):
                at, weight, counts, now = (v[open_] for v in (at, weight, counts, now))
                open_ = np.ones(n, bool)
    return gamma, exp_digamma(gamma) / exp_digamma(gamma.sum(1))[:, None]


def _padded(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, terms, counts) of a batch of (id, sparse vector), some rows of
    about as many terms at a time, filled up with counts of zero."""
    terms, counts = (pc.struct_field(batch.column("v"), f) for f in ("indices", "values"))
    size = pc.list_value_length(terms).to_numpy()
    terms, counts = terms.flatten().to_numpy(), counts.flatten().to_numpy()
    begin, order = np.cumsum(size) - size, np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        cells = np.maximum(size[order[at:]], 1) * np.arange(1, len(order) - at + 1) * k
        part = order[at:at + max(1, int(np.searchsorted(cells, FIT_CELLS, side="right")))]
        at += len(part)
        place = np.arange(max(int(size[part[-1]]), 1))
        there = place < size[part][:, None]
        held = (begin[part][:, None] + place)[there]
        t, c = np.zeros(there.shape, np.int32), np.zeros(there.shape)
        t[there], c[there] = terms[held], counts[held]
        yield batch.column("id").take(pa.array(part)), t, c


def _groups(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The groups of ``_padded``, one a row, as the bytes of their terms and counts."""
    for batch in batches:
        for _, terms, counts in _padded(batch, k):
            yield pa.RecordBatch.from_arrays([pa.array([len(terms)], pa.int32()), pa.array([terms.tobytes()]), pa.array([counts.tobytes()])],
                                             ["docs", "terms", "counts"])


@dataclass
class TopicModel:
    """Terms, topics (k x terms, Dirichlet), the bound per word after each
    iteration, and the documents of the fit as (id, counts)."""
    spark: SparkSession
    vocab: list[str]
    weights: np.ndarray
    alpha: float
    bounds: list[float]
    stop_words: list[str]
    fitted: DataFrame | None = None

    def _counts(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return bag_of_words(df, id_col, text_col, self.vocab, self.stop_words)

    def dominant(self, df: DataFrame | None, id_col: str, text_col: str | None = None) -> DataFrame:
        """(id, dominant_topic, dominant_topic_prob) of every row; a text without
        vocabulary words has the uniform prior, topic 0 at 1 / k.  Without
        ``df``, of the documents of the fit, whose words are counted already."""
        shared = self.spark.sparkContext.broadcast((np.exp(_log_shares(self.weights)), self.alpha))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            topics, alpha = shared.value
            for batch in batches:
                for ids, terms, counts in _padded(batch, len(topics)):
                    gamma, _ = fit_documents(terms, counts, topics, alpha)
                    p = gamma / gamma.sum(1)[:, None]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(p.argmax(1).astype(np.int32)), pa.array(p.max(1))],
                                                     ["id", "dominant_topic", "dominant_topic_prob"])

        rows = self.fitted if df is None else self._counts(df, id_col, text_col)
        schema = T.StructType([rows.schema["id"], T.StructField("dominant_topic", T.IntegerType()), T.StructField("dominant_topic_prob", T.DoubleType())])
        return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

    def words(self, n: int = 10) -> DataFrame:
        """Top ``n`` words of each topic: (topic, rank, word, weight), heaviest
        first, ties in the order of the vocabulary."""
        share = self.weights / self.weights.sum(1)[:, None]
        rows = [(t, r, self.vocab[i], float(share[t, i])) for t in range(len(share))
                for r, i in enumerate(np.argsort(-share[t], kind="stable")[:n].tolist())]
        return self.spark.createDataFrame(rows, "topic int, rank int, word string, weight double")


def bag_of_words(df: DataFrame, id_col: str, text_col: str, vocab: list[str], stop_words: list[str] | None) -> DataFrame:
    """(id, v): sparse vectors of how often each term of ``vocab`` occurs."""
    made = term_counts(df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("_text")), "_text", vocab, stop_words, "v")
    return made.select("id", "v")


def fit_topics(df: DataFrame, id_col: str, text_col: str, k: int = 8, max_iter: int = 100, seed: int = 42,
               stop_words: list[str] | None = None, max_terms: int = 500, min_df: int = 3, max_df: float = 0.5,
               tolerance: float = 1e-5) -> TopicModel:
    """Fit ``k`` topics over the corpus vocabulary; priors of documents and
    topics are 1 / k.  Ends after ``max_iter`` iterations, or once the bound
    rises by less than ``tolerance`` a word.  Without vocabulary words the
    topics stay as drawn from ``seed``."""
    spark = df.sparkSession
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    vocab = [r["term"] for r in vocabulary(df, id_col, text_col, stop_words, max_terms, min_df, max_df).collect()]  # at most max_terms
    width, prior = max(len(vocab), 1), 1.0 / k
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (k, width))
    model = TopicModel(spark, vocab, weights, prior, [], stop_words)
    if not vocab:
        model.vocab = [""]
        model.fitted = bag_of_words(df, id_col, text_col, model.vocab, stop_words)
        return model
    rows = bag_of_words(df, id_col, text_col, vocab, stop_words)
    # The counts are a small part of the texts: read as they lie, they would be few slices, some far larger than others.
    model.fitted = stage_table(rows, "bag").repartition(SLICES * spark.sparkContext.defaultParallelism)
    # Documents don't change from one iteration to the next, so they are laid out for the fit once.
    held = model.fitted.mapInArrow(lambda batches: _groups(batches, k), "docs int, terms binary, counts binary").persist()
    names = [f"s{t}" for t in range(k)]
    schema = "term int, " + ", ".join(f"{n} double" for n in names)
    try:
        for _ in range(max_iter):
            logs = _log_shares(model.weights)
            shared = spark.sparkContext.broadcast(np.exp(logs))

            def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                topics = shared.value
                sums, bound, n = np.zeros_like(topics), 0.0, 0.0
                for batch in batches:
                    for docs, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                        terms, x = (np.frombuffer(v, t).reshape(docs, -1) for v, t in zip(packed, (np.int32, float)))
                        gamma, theta = fit_documents(terms, x, topics, prior)
                        norm = np.einsum("dk,kdm->dm", theta, topics[:, terms]) + _TINY
                        part = x / norm
                        for t, own in enumerate(theta.T):
                            sums[t] += np.bincount(terms.ravel(), (part * own[:, None]).ravel(), topics.shape[1])
                        shares = _log_shares(gamma)
                        bound += (x * np.log(norm)).sum() + ((prior - gamma) * shares).sum() + (log_gamma(gamma) - log_gamma(np.array(prior))).sum()
                        bound += (log_gamma(np.array(prior * len(topics))) - log_gamma(gamma.sum(1))).sum()
                        n += x.sum()
                # Terms -1 and -2 hold the bound and the number of words.
                table = np.concatenate([(sums * topics).T, np.zeros((2, len(topics)))])
                table[-2:, 0] = bound, n
                terms = np.append(np.arange(topics.shape[1]), [-1, -2]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(terms), *[pa.array(table[:, t]) for t in range(len(topics))]], ["term", *names])

            got = held.mapInArrow(expect, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).toPandas().set_index("term")
            shared.unpersist()
            bound, n = got.loc[-1].iloc[0], got.loc[-2].iloc[0]
            bound += ((prior - model.weights) * logs).sum() + (log_gamma(model.weights) - log_gamma(np.array(prior))).sum()
            bound += (log_gamma(np.array(prior * width)) - log_gamma(model.weights.sum(1))).sum()
            model.bounds.append(float(bound / n))
            model.weights = prior + got.drop(index=[-1, -2]).sort_index().to_numpy().T
            if len(model.bounds) > 1 and model.bounds[-1] - model.bounds[-2] < tolerance:
                break
    finally:
        held.unpersist()
    return model

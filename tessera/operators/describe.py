"""Labels by the similarity of a text to descriptions of the labels.

A candidate label is a sentence.  Its words that the corpus vocabulary holds are
its seeds; the terms that occur in the same documents as the seeds most often
(for how often they occur at all) are added with a smaller weight, so that a
label also meets texts that say it in other words.  Texts and labels are TF-IDF
vectors over the vocabulary; their cosines, sharpened by a temperature that is
fitted on the corpus itself, become scores.

The model is small whatever the corpus (labels x vocabulary), so it is
held by every task: a text becomes its counts of the vocabulary's terms and is
scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.models import term_counts, tokens, vocabulary
from tessera.session import stage_table

#: Terms added to a label, their weight beside a seed, and the temperatures tried.
EXPAND, SHARE = 20, 0.5
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
#: Cosines are compared at this many decimals, so that any order of summation gives the same label.
DECIMALS = 9


@dataclass
class LabelModel:
    """``terms`` is (term, idf, weights, seeds): weights of the unit label
    vectors and whether the term is a seed, both in the order of ``names``."""
    names: list[str]
    terms: DataFrame
    stop_words: list[str]
    temperature: float = 0.1
    means: list[float] = field(default_factory=list)  # mean cosine of each label over the corpus


def _label_terms(bags: DataFrame, terms: list[str], vocab: DataFrame, descriptions: dict[str, str],
                 n_docs: int, expand: int, share: float) -> DataFrame:
    """(label, term, weight, seed), unit vectors; labels are numbered from 0.
    ``bags`` are over ``terms``, the vocabulary in order."""
    spark = bags.sparkSession
    idf = F.log((F.lit(float(n_docs)) + 1.0) / (F.col("docs") + 1.0))
    known = vocab.select("term", "docs", idf.alias("idf"))  # at most max_terms rows
    rows = spark.createDataFrame(list(enumerate(descriptions.values())), "label int, words string")
    seeds = (rows.select("label", F.explode(tokens(F.col("words"))).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("c"))
             .join(F.broadcast(known), "term"))
    seeds = stage_table(seeds, "seeds")
    held = {r["term"] for r in seeds.select("term").distinct().collect()}
    at = np.array([i for i, t in enumerate(terms) if t in held], np.int64)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(at), len(terms)), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = batch.column("terms").slice(start, 512)
                x = np.zeros((len(found), len(terms)))
                x[np.repeat(np.arange(len(found)), pc.list_value_length(found).to_numpy(zero_copy_only=False)), found.flatten().to_numpy(zero_copy_only=False)] = 1
                sums += (x[:, at].T @ x).astype(np.int64)
        i, j = np.nonzero(sums)
        names = pa.array(terms, pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(at[i])), names.take(pa.array(j)), pa.array(sums[i, j])], ["seed", "term", "n"])

    # In how many documents a seed and a term occur together: a task adds up its
    # documents, so only (seed, term) counts are shuffled.
    both = bags.select(F.unwrap_udt("v")["indices"].alias("terms")).mapInArrow(together, "seed string, term string, n long")
    both = both.groupBy("seed", "term").agg(F.sum("n").alias("n"))
    a, b = known.select(F.col("term").alias("seed"), F.col("docs").alias("seed_docs")), known.select("term", "docs")
    close = both.join(F.broadcast(a), "seed").join(F.broadcast(b), "term").select(
        "seed", "term", (F.col("n") / F.sqrt(F.col("seed_docs").cast("double") * F.col("docs"))).alias("a"))
    sizes = seeds.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    near = (close.join(F.broadcast(seeds.select("label", F.col("term").alias("seed"))), "seed").groupBy("label", "term").agg(F.sum("a").alias("a"))
            .join(F.broadcast(sizes), "label").select("label", "term", F.round(F.col("a") / F.col("size"), DECIMALS).alias("a"))
            .join(F.broadcast(seeds.select("label", "term")), ["label", "term"], "left_anti"))
    first = Window.partitionBy("label").orderBy(F.desc("a"), "term")  # at most max_terms rows a label
    added = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= expand)
    weights = seeds.select("label", "term", (F.col("c") * F.col("idf")).alias("w"), F.lit(True).alias("seed")).unionByName(
        added.join(F.broadcast(known), "term").select("label", "term", (F.lit(share) * F.col("a") * F.col("idf")).alias("w"), F.lit(False).alias("seed")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("label")))
    return weights.select("label", "term", F.coalesce(F.try_divide("w", norm), F.lit(0.0)).alias("w"), "seed")


def fit_labels(df: DataFrame, id_col: str, text_col: str, descriptions: dict[str, str], stop_words: list[str] | None = None,
               max_terms: int = 500, min_df: int = 3, max_df: float = 0.5, expand: int = EXPAND, share: float = SHARE,
               temperature: float | None = None) -> LabelModel:
    """Fit on a corpus.  ``descriptions`` maps each label to its sentence.

    Unless given, the temperature is the one of ``TEMPERATURES`` under which
    documents that hold seeds of exactly one label have that label with the
    least mean surprise (the first on ties, 0.1 without such documents).  Rows
    without text count as empty; a label none of whose words the corpus holds
    has cosine 0 with every text."""
    if not descriptions:
        raise ValueError("at least one label is required")
    stop_words = StopWordsRemover.loadDefaultStopWords("english") if stop_words is None else stop_words
    names = list(descriptions)
    vocab = stage_table(vocabulary(df, id_col, text_col, stop_words, max_terms, min_df, max_df), "vocabulary")
    n_docs = df.count()
    known = [r["term"] for r in vocab.select("term").orderBy("term").collect()]  # at most max_terms
    bags = stage_table(_bags(df, [id_col], text_col, known), "bags")  # texts are taken apart once
    labels = _label_terms(bags, known, vocab, descriptions, n_docs, expand, share).groupBy("term").agg(*[
        f(F.when(F.col("label") == i, c)).alias(f"{p}{i}") for i in range(len(names)) for f, c, p in
        ((F.max, F.col("w"), "w"), (F.max, F.col("seed"), "s"))])
    idf = F.log((F.lit(float(n_docs)) + 1.0) / (F.col("docs") + 1.0))
    terms = vocab.select("term", idf.alias("idf")).join(F.broadcast(labels), "term", "left").select(
        "term", "idf", F.array(*[F.coalesce(f"w{i}", F.lit(0.0)) for i in range(len(names))]).alias("weights"),
        F.array(*[F.coalesce(f"s{i}", F.lit(False)) for i in range(len(names))]).alias("seeds"))
    model = LabelModel(names, stage_table(terms, "label_terms"), stop_words)
    if temperature is not None:
        model.temperature = temperature
    fitted = _cosines_of(model, model.terms.orderBy("term").collect(), bags, [id_col])
    only = F.size(F.filter("seeds", lambda s: s)) == 1
    at = F.array_position("seeds", True).cast("int")
    surprise = [F.avg(F.when(only, -F.log(F.element_at(softmax(F.col("cosines"), t), at)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    row = fitted.agg(*surprise, *[F.avg(F.col("cosines")[i]).alias(f"m{i}") for i in range(len(names))]).first()
    model.means = [row[f"m{i}"] or 0.0 for i in range(len(names))]
    if temperature is None and row["t0"] is not None:
        losses = [round(row[f"t{i}"], DECIMALS) for i in range(len(TEMPERATURES))]
        model.temperature = TEMPERATURES[losses.index(min(losses))]
    return model


def _cosines(model: LabelModel, df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, cosines, seeds), one row per key: rows of one key are one text."""
    known = model.terms.orderBy("term").collect()  # at most max_terms rows
    return _cosines_of(model, known, _bags(df, keys, text_col, [r["term"] for r in known]), keys)


def _bags(df: DataFrame, keys: list[str], text_col: str, vocab: list[str]) -> DataFrame:
    """(keys, v): how often each term of ``vocab`` occurs in every row's text."""
    texts = df.select(*[F.col(k) for k in keys], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return term_counts(texts, "_text", vocab or [""], None, "v").select(*keys, "v")


def _cosines_of(model: LabelModel, known: list, bags: DataFrame, keys: list[str]) -> DataFrame:
    """Cosines of bags over ``known``, the terms in their order.  A bag is scored
    where it lies; only if a key repeats are the bags of a key added up first."""
    n, width = len(model.names), max(len(known), 1)
    idf = np.array([r["idf"] for r in known] or [0.0])
    weights = np.array([r["weights"] for r in known] or [[0.0] * n]).reshape(width, n)
    seeds = np.array([r["seeds"] for r in known] or [[False] * n], bool).reshape(width, n)

    @F.arrow_udf("struct<cosines: array<double>, seeds: array<boolean>>")
    def score(terms: pa.Array, counts: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
        term = terms.flatten().to_numpy(zero_copy_only=False)
        x = counts.flatten().to_numpy(zero_copy_only=False) * idf[term]
        norm = np.sqrt(np.bincount(row, x * x, len(terms)))
        dot = np.stack([np.bincount(row, x * weights[term, i], len(terms)) for i in range(n)], 1)
        held = np.stack([np.bincount(row, seeds[term, i], len(terms)) > 0 for i in range(n)], 1)
        cosine = np.divide(dot, norm[:, None], out=np.zeros(dot.shape), where=norm[:, None] != 0)
        ends = np.arange(len(terms) + 1, dtype=np.int32) * n
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(cosine.ravel())),
                                           pa.ListArray.from_arrays(ends, pa.array(held.ravel()))], ["cosines", "seeds"])

    sparse = bags.select(*keys, F.unwrap_udt("v").alias("v")).select(*keys, F.col("v.indices").alias("terms"), F.col("v.values").alias("counts"))
    if not bags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        each = sparse.select(*keys, F.explode_outer(F.arrays_zip("terms", "counts")).alias("e")).select(*keys, "e.terms", "e.counts")
        added = each.groupBy(*keys, "terms").agg(F.sum("counts").alias("counts")).groupBy(*keys).agg(
            F.collect_list(F.when(F.col("terms").isNotNull(), F.struct("terms", "counts"))).alias("e"))  # at most max_terms a key
        sparse = added.select(*keys, F.col("e.terms").alias("terms"), F.col("e.counts").alias("counts"))
    scored = sparse.select(*keys, score("terms", "counts").alias("s"))
    return scored.select(*keys, F.transform("s.cosines", lambda c: F.round(c, DECIMALS)).alias("cosines"), F.col("s.seeds").alias("seeds"))


def softmax(values: Column, temperature: float) -> Column:
    """Shares of exp(value / temperature), computed from the largest."""
    powers = F.transform(values, lambda v: F.exp((v - F.array_max(values)) / F.lit(temperature)))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def score_labels(model: LabelModel, df: DataFrame, keys: list[str], text_col: str, multi_label: bool = False) -> DataFrame:
    """(keys, cosines, scores) for every row of ``df``, in the order of
    ``model.names``.  Scores are shares that add up to 1, or, with
    ``multi_label``, each label against its own mean over the corpus.  A row
    without vocabulary words has cosine 0 with every label."""
    out = _cosines(model, df, keys, text_col).select(*keys, "cosines")
    if multi_label:
        scores = F.array(*[1.0 / (1.0 + F.exp((F.lit(m) - F.col("cosines")[i]) / F.lit(model.temperature))) for i, m in enumerate(model.means)])
    else:
        scores = softmax(F.col("cosines"), model.temperature)
    return out.withColumn("scores", scores)


def score_chunks(model: LabelModel, df: DataFrame, id_col: str, text_col: str, size: int = 300) -> DataFrame:
    """(id, chunk_no, label, score): the best label of every chunk of ``size``
    words (the first on ties)."""
    from tessera.functions import text as tx
    from tessera.operators.labels import top_label
    chunks = df.select(id_col, F.posexplode(tx.chunk_words(text_col, size)).alias("chunk_no", "ws")).select(
        id_col, "chunk_no", F.array_join("ws", " ").alias("chunk"))
    best = top_label(F.col("scores"), model.names, threshold=float("-inf"))
    return score_labels(model, chunks, [id_col, "chunk_no"], "chunk").select(id_col, "chunk_no", best.alias("b")).select(
        id_col, "chunk_no", F.col("b.label").alias("label"), F.col("b.score").alias("score"))

"""Label and sentiment operators.

Scorers are pluggable: a lexicon table (word -> weights) joined to the
words of each chunk, or a caller's classifier, run over texts
(``models.batch_scores``) or chunks (``models.chunked_scores``) in Arrow
batches.  Neural models are not bundled.

Scale notes: words are exploded and joined in one stage and combined per chunk
before the shuffle; the planner picks the join by the lexicon's size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import checkpoint_dir
from tessera.schemas import SENTIMENT_LABELS, UNSURE

# Normalisation constant of the compound lexicon score s / sqrt(s^2 + alpha).
COMPOUND_ALPHA = 15.0


def scores_struct(pos: Column, neu: Column, neg: Column, null_when: Column | None = None) -> Column:
    s = F.struct(pos.cast("double").alias("positive"), neu.cast("double").alias("neutral"),
                 neg.cast("double").alias("negative"))
    return s if null_when is None else F.when(~null_when, s)


def label_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """``value_counts(dropna=False)`` with percent of total, rounded half-even
    to 2 decimals.

    The input is scanned once: the grouped counts are checkpointed and the
    total is summed from them as a scalar, so no step gathers the groups
    into one task whatever the column's cardinality.
    """
    counted = df.groupBy(F.col(label_col).alias(label_col)).agg(
        F.count(F.lit(1)).alias("count")).persist()
    checkpoint_dir(df.sparkSession)
    g = counted.checkpoint()
    counted.unpersist()
    total = g.agg(F.sum("count")).first()[0] or 0
    pct = F.bround(F.col("count") / F.lit(float(total)) * 100.0, 2) if total else F.lit(None).cast("double")
    return g.select(label_col, "count", pct.alias("percent"))


def crosstab(df: DataFrame, scorer_cols: dict[str, str],
             labels: list[str] = SENTIMENT_LABELS) -> DataFrame:
    """Label x scorer contingency table (rows: labels, columns: scorers), zeros
    filled; one pass over the data."""
    names = list(scorer_cols)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("scorer"), F.col(c).alias("label"))
        for n, c in scorer_cols.items()])).alias("x")).select("x.scorer", "x.label")
    return (long.where(F.col("label").isin(labels))
                .groupBy("label").pivot("scorer", names).count().na.fill(0, subset=names))


def agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of rows where two label columns are equal; null never agrees."""
    return df.agg(*[F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")).alias(n)
                    for n, (a, b) in pairs.items()])


def top_label(scores: Column, names: list[str], threshold: float = 0.5,
              default: str = UNSURE) -> Column:
    """Highest-scoring candidate (first on ties) as struct(label, score);
    (default, 0.0) when the best score is below ``threshold`` or no scores."""
    cands = F.transform(F.arrays_zip(scores.cast("array<double>").alias("s"),
                                     F.array(*[F.lit(n) for n in names]).alias("l"),
                                     F.sequence(F.lit(1), F.lit(len(names))).alias("i")),
                        lambda z: F.struct(z["s"].alias("score"), (-z["i"]).alias("neg_idx"),
                                           z["l"].alias("label")))
    best = F.array_max(cands)
    ok = best.isNotNull() & (best["score"] >= threshold)
    return F.struct(F.when(ok, best["label"]).otherwise(F.lit(default)).alias("label"),
                    F.when(ok, best["score"]).otherwise(F.lit(0.0)).alias("score"))


def label_where(df: DataFrame, cond: Column, scores: Column, names: list[str],
                threshold: float = 0.5, prefix: str = "secondary") -> DataFrame:
    """Top label for rows meeting ``cond``; (UNSURE, 0.0) for the others."""
    t = top_label(scores, names, threshold)
    return df.withColumn(f"{prefix}_label", F.when(cond, t["label"]).otherwise(F.lit(UNSURE))) \
             .withColumn(f"{prefix}_score", F.when(cond, t["score"]).otherwise(F.lit(0.0)))


def primary_from_top(label: Column) -> Column:
    """Map a primary candidate label to TECHNICAL / NON_TECHNICAL (UNSURE kept)."""
    return (F.when(label == UNSURE, F.lit(UNSURE))
             .when(F.lower(label).contains("technical"), F.lit("TECHNICAL"))
             .otherwise(F.lit("NON_TECHNICAL")))


def _words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, word) of every text in lower case; a text without words stays
    as one row of nulls.  Words are exploded in generated code; one partial
    aggregation after the lexicon join leaves a row per chunk."""
    return df.select(id_col, F.posexplode_outer(tx.words(F.lower(F.col(text_col)))).alias("pos", "word"))


def chunked_lexicon_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                              size: int = 300, cut: float = 0.05) -> DataFrame:
    """Score each ``size``-word chunk with a lexicon, average over chunks and
    label with an inclusive cut-off.

    chunk score = s / sqrt(s^2 + alpha), s = sum of weights of the chunk's
    (lower-cased) words; chunks without hits score 0 and still count in the
    average.  Blank text is neutral with score null.
    """
    lex = lexicon.select(F.lower("word").alias("word"), F.col("weight").cast("double").alias("weight"))
    words = _words(df, id_col, text_col).select(id_col, F.floor(F.col("pos") / size).alias("chunk_no"), "word")
    sums = words.join(lex, "word", "left").groupBy(id_col, "chunk_no").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("s"))
    chunk = F.when(F.col("chunk_no").isNotNull(),
                   F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(COMPOUND_ALPHA)))
    out = sums.groupBy(id_col).agg(F.avg(chunk).alias("score"))
    return out.select(id_col, "score",
                      F.when(F.col("score").isNull(), F.lit("neutral"))
                       .otherwise(tx.polarity_label("score", cut, inclusive=True)).alias("label"))


def lexicon_polarity(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                     cut: float = 0.05) -> DataFrame:
    """Polarity and subjectivity as the mean weights of the matched words, label
    with a strict cut-off; no hits or blank text give (0, 0, neutral)."""
    lex = lexicon.select(F.lower("word").alias("word"), F.col("polarity").cast("double").alias("polarity"),
                         F.col("subjectivity").cast("double").alias("subjectivity"))
    hits = _words(df, id_col, text_col).join(lex, "word", "left")
    agg = hits.groupBy(id_col).agg(F.avg("polarity").alias("p"), F.avg("subjectivity").alias("q"))
    pol = F.coalesce("p", F.lit(0.0))
    return agg.select(id_col, pol.alias("tb_polarity"),
                      F.coalesce("q", F.lit(0.0)).alias("tb_subjectivity"),
                      tx.polarity_label(pol, cut, inclusive=False).alias("tb_sentiment"))


def chunk_vote_sentiment(chunk_scores: DataFrame, id_col: str, docs: DataFrame | None = None,
                         labels: list[str] = SENTIMENT_LABELS) -> DataFrame:
    """Per chunk the classifier's top label adds its score to that label; the
    sums are normalised by their total and the largest wins, ties resolved in
    the order of ``labels``.  ``docs`` (id only) adds rows with no chunks as
    nulls."""
    sums = chunk_scores.groupBy(id_col).agg(*[
        F.sum(F.when(F.col("label") == l, F.col("score")).otherwise(F.lit(0.0))).alias(f"_{l}")
        for l in labels])
    tot = sum((F.col(f"_{l}") for l in labels), F.lit(0.0))
    normed = sums.select(id_col, *[F.try_divide(F.col(f"_{l}"), tot).alias(l) for l in labels])
    best = F.greatest(*[F.col(l) for l in labels])
    lab = F.when(F.col(labels[0]) == best, F.lit(labels[0]))
    for l in labels[1:]:
        lab = lab.when(F.col(l) == best, F.lit(l))
    out = normed.select(id_col, lab.alias("roberta_label"),
                        scores_struct(F.col(labels[0]), F.col(labels[1]), F.col(labels[2]))
                        .alias("roberta_scores"))
    if docs is not None:
        out = docs.select(id_col).join(out, id_col, "left")
    return out.select(id_col, "roberta_label", "roberta_scores",
                      F.col("roberta_scores.positive").alias("roberta_pos_score"),
                      F.col("roberta_scores.negative").alias("roberta_neg_score"))


def query_sentiment(queries: DataFrame, id_col: str, text_col: str, lexicon: DataFrame,
                    max_chars: int = 1000, polarity=lexicon_polarity) -> DataFrame:
    """Polarity, subjectivity and label of each query's first ``max_chars``
    characters, by the scorer ``polarity`` (``lexicon_polarity``, or
    ``rules.rule_polarity`` for one that minds the order of words)."""
    q = queries.select(id_col, F.substring(F.col(text_col), 1, max_chars).alias("_q"))
    r = polarity(q, id_col, "_q", lexicon)
    return r.select(id_col, F.col("tb_polarity").alias("query_polarity"),
                    F.col("tb_subjectivity").alias("query_subjectivity"),
                    F.col("tb_sentiment").alias("query_sentiment_label"))

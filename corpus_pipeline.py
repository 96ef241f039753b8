"""The training-data pipeline over ``documents``: five stages, each on all that
the one before kept, written as Parquet in between."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm.common import pack, read, stage, unpack
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.mixing import emit, mix
from tessera.llm.near_dedup import near_duplicates


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it learns from the labelled
    rows of ``docs`` outside the held-out fold.  Null and empty texts are scored
    as the empty text, repeated rows alike."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    kept = pack(docs).withColumn("score", quality.quality_score(model, F.col("__row.text")))
    return unpack(kept.where(F.col("score") >= quality.CUT), docs.columns)


def line_dedup(spark, docs, sf_dir):
    """Repeated three-line windows lose their later occurrences; a document
    that loses all its lines goes, and ``n_chars`` follows the text."""
    own = {c: f"__in_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}  # the input's, which stay
    done = dedup_lines(docs.withColumnsRenamed(own))
    left = done.where((F.col("n_removed") == 0) | (F.trim(F.coalesce("text", F.lit(""))) != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays: the one with the
    smallest id, of several texts under that id the one with the smallest
    hash.  A group without any id keeps one too; rows equal in id and text
    are one document."""
    found = near_duplicates(docs)
    stay = (found.where(F.col("kept") | F.col("component_id").isNull())
            .groupBy(F.col("doc_id").alias("id"), "group").agg(F.min("text_hash").alias("th"))
            .select(F.struct("id", "th").alias("stay")))
    row = F.col("__row")
    keyed = pack(docs).withColumn("key", F.struct(
        row["doc_id"].alias("id"), F.xxhash64(F.coalesce(row["text"], F.lit(""))).alias("th")))
    return unpack(keyed.join(stay, F.col("key") == F.col("stay"), "left_semi").dropDuplicates(["key"]), docs.columns)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """Every document as often as its source's repetition rate says; the
    columns that this adds (size to taken, and copy) replace input columns of
    the same names."""
    return emit(mix(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Compression, MinHash and SimHash have no SQL form; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs)
    return docs

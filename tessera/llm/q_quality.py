"""Query over ``documents`` and ``labels``: quality scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.quality import classify, held_out, train
from tessera.llm.registry import register


@register("op6_quality")
def op6_quality(spark, sf_dir):
    """Quality score of every document."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

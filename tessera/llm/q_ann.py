"""Query over ``embeddings``: nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm.ann import nearest
from tessera.llm.common import read
from tessera.llm.registry import register


@register("op8_ann")
def op8_ann(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

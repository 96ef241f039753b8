"""Query over ``documents``: near-duplicate groups."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.registry import register


@register("op4_near_dedup")
def op4_near_dedup(spark, sf_dir):
    """Near-duplicate group of every document."""
    return near_duplicates(read(spark, sf_dir, "documents"))

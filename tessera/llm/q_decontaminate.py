"""Query over ``documents`` and ``benchmark``: benchmark passages."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.decontaminate import matches
from tessera.llm.registry import register


@register("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    """Benchmark items found in documents, with the best window of each."""
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})

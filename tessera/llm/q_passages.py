"""Query over ``documents``: passages that documents share."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.passages import shared_passages
from tessera.llm.registry import register


@register("op10_passages")
def op10_passages(spark, sf_dir):
    """Fuzzy passages shared with another document."""
    return shared_passages(read(spark, sf_dir, "documents")).withColumnsRenamed(
        {"id": "doc_id", "ref_id": "ref_doc_id"})

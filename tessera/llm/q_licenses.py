"""Query over ``documents``: license notices."""

from __future__ import annotations

from tessera.llm.common import read
from tessera.llm.licenses import scan_licenses
from tessera.llm.registry import register


@register("op2_licenses")
def op2_licenses(spark, sf_dir):
    """License notices of every document."""
    return scan_licenses(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

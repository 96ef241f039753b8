"""All queries of the pipeline operators."""

from tessera.llm import (q_ann, q_bpe, q_decontaminate, q_dedup, q_html, q_licenses, q_near, q_passages, q_pii,  # noqa: F401
                         q_quality, q_trie, q_variants)
from tessera.llm.registry import ORACLE, QUERIES  # noqa: F401

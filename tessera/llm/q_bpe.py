"""Query over ``documents``: byte-level BPE there and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm.bpe import Vocabulary, decode, encode
from tessera.llm.common import read
from tessera.llm.registry import register


@register("op11_bpe")
def op11_bpe(spark, sf_dir):
    """Number and digest of every document's token ids, and the digest of what they decode to."""
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = decode(encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    return coded.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""One-pass matching against the plain expressions and against Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import multimatch as mm
from tessera.functions import text as tx
from tessera.schemas import AI_KEYWORDS, AI_STEMS, SHORT_EXACT


def test_all_overlapping_matches_are_found(monkeypatch):
    rnd = random.Random(1)
    for lanes in (1, 7, 4096):
        monkeypatch.setattr(mm, "LANES", lanes)
        patterns = list(dict.fromkeys("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))) for _ in range(30)))
        text = "".join(rnd.choice("abc") for _ in range(5000))
        end, k = mm.Automaton(patterns).matches(np.array([ord(c) for c in text]))
        got = sorted(zip(end.tolist(), k.tolist()))
        want = sorted((i + len(p), j) for j, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert got == want


def test_equals_the_plain_expressions(spark):
    rnd = random.Random(2)
    words = ["rag", "RAG", "storage", "agi", "agile", "pii", "Hallucination", "token", "a.i.", " ai ", "aaa", "école", "rag-time", "_rag_", "LLM", "é", "x"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "rag", "aaaaaaa", "RAG\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    out = df.select(F.coalesce(tx.stem_hits("t", AI_STEMS, SHORT_EXACT), F.lit(0)).alias("a"), mm.hits_once("t", AI_STEMS, SHORT_EXACT).alias("b"),
                    F.coalesce(tx.keyword_occurrences("t", AI_KEYWORDS + ["aa", "aa"]), F.lit(0)).alias("c"),
                    mm.occurrences_once("t", AI_KEYWORDS + ["aa", "aa"]).alias("d"))
    rows = out.collect()
    assert len(rows) == len(texts) and all(r.a == r.b and r.c == r.d for r in rows)
    assert max(r.a for r in rows) > 3 and max(r.c for r in rows) > 5


def test_counts_like_python(spark, monkeypatch):
    monkeypatch.setattr(mm, "CHARS", 50)  # several slices
    rnd = random.Random(3)
    patterns = ["aa", "aba", "b", "abab", "c"]
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    import pyarrow as pa
    got = mm._counts(mm.Automaton(patterns), np.zeros(5, bool), pa.array(texts))
    assert got.tolist() == [[t.count(p) for p in patterns] for t in texts]


def test_patterns_are_checked():
    for bad in (["a", ""], ["a", "a"]):
        with pytest.raises(ValueError):
            mm.Automaton(bad)


def test_memory_does_not_grow_with_the_batch():
    """A batch is handled in slices, so its size in characters is not held at several times over."""
    import tracemalloc

    import pyarrow as pa
    texts = pa.array(["the agile rag " * 100] * 5000)  # seven million characters
    automaton, whole = mm.Automaton(["rag", "agile"]), np.array([True, False])
    mm._word_characters()
    tracemalloc.start()
    try:
        found = mm._counts(automaton, whole, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.sum() == 1_000_000 and peak < 64 << 20

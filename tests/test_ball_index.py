"""The pruned search gives what the full one gives, and reads less."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import ball_index as bi
from tessera.operators import vectors as vo


def _clustered(spark, n, width=16, seed=2):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(20, width))
    rows = [(i, ("news", "dev", None)[i % 3], [float(x) for x in middles[i % 20] + 0.15 * rng.normal(size=width)], f"t{i}") for i in range(n)]
    rows += [(n + j, "news", rows[j][2], "copy") for j in range(40)]  # ties
    rows += [(n + 100, "dev", [0.0] * width, "zero"), (n + 101, "dev", [1.0], "short"), (n + 102, "dev", None, "null"),
             (n + 103, "dev", [float("nan")] * width, "nan"), (None, "dev", rows[0][2], "no id")]
    return spark.createDataFrame(rows, "id long, corpus string, embedding array<double>, title string")


def _rows(df):
    return sorted((tuple(r) for r in df.select("query_id", "corpus", "rank", "id", F.round("cosine", 9), "title").collect()), key=str)


def test_equals_the_full_search_and_reads_less(spark, tmpdir_fresh):
    df = _clustered(spark, 3000).repartition(4)
    q = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding").union(
        spark.createDataFrame([(-1, [0.0] * 16), (-2, [2.0] * 16)], "query_id long, embedding array<double>"))
    index = bi.build(df, f"{tmpdir_fresh}/index", width=16, carry=["title"])
    got, report = bi.search(index, q, 4)
    assert _rows(got) == _rows(vo.similarity_topk(df, q, 4, width=16, carry=["title"]))
    near = q.where("query_id >= 0")
    _, report = bi.search(index, near.limit(3), 4)
    assert report["read"] < 0.5 * report["full"], report


def test_blocks_and_reopened_index(spark, tmpdir_fresh, monkeypatch):
    df = _clustered(spark, 400)
    bi.build(df, f"{tmpdir_fresh}/index", width=16, cells=5, carry=["title"])
    index = bi.open_index(spark, f"{tmpdir_fresh}/index", 16)
    assert index.n.sum() == df.where("id IS NOT NULL AND embedding IS NOT NULL").count()
    q = df.where("id < 60").select(F.col("id").cast("string").alias("query_id"), "embedding")
    monkeypatch.setattr(bi, "BLOCK_BOUNDS", 20 * len(index.n))
    got, report = bi.search(index, q, 2)
    assert report["blocks"] > 2 and _rows(got) == _rows(vo.similarity_topk(df, q, 2, width=16, carry=["title"]))


def test_edges(spark, tmpdir_fresh):
    df = _clustered(spark, 60)
    index = bi.build(df, f"{tmpdir_fresh}/a", width=16)
    q = df.where("id = 1").select(F.col("id").alias("query_id"), "embedding")
    assert bi.search(index, q.limit(0), 3)[0].count() == 0
    assert bi.search(index, q, 1000)[0].count() == 60 + 40 + 3
    empty = bi.build(df.limit(0), f"{tmpdir_fresh}/b", width=16)
    assert bi.search(empty, q, 3)[0].count() == 0
    with pytest.raises(ValueError):
        bi.search(index, spark.createDataFrame([(None, [1.0])], "query_id long, embedding array<double>"))
    with pytest.raises(ValueError):
        bi.search(index, q, 0)


def test_small_balls_are_merged_together_and_ruled_out_rows_left(monkeypatch):
    """Many balls of few rows each: the best so far are not sorted again for every ball."""
    rng = np.random.default_rng(5)
    x, q = np.round(rng.normal(size=(900, 8)), 3), np.round(rng.normal(size=(40, 8)), 3)
    batches = [pa.RecordBatch.from_pydict({"id": list(range(a, a + 6)), "corpus": ["news" if c % 2 else None] * 6, "vec": x[a:a + 6].tolist(), "cell": [c] * 6})
               for c, a in enumerate(range(0, 900, 6))]
    calls, best = [], bi._best
    monkeypatch.setattr(bi, "_best", lambda *a: calls.append(1) or best(*a))

    def found(kth):
        visits = {f"{c}\0news" if c % 2 else f"{c}": (np.arange(40), kth) for c in range(150)}
        parts = list(bi._visitor(SimpleNamespace(value=(q, visits)), 3, 8, 9)(iter(batches)))
        return sorted((r["q"], str(r["corpus"]), -r["cosine"], r["id"]) for p in parts for r in p.to_pylist())

    scores = np.round(x @ q.T, 9)
    own = np.arange(900) // 6 % 2 == 1
    want = sorted((j, name, -scores[i, j], i) for name, some in (("news", own), ("None", ~own)) for j in range(40)
                  for i in sorted(np.flatnonzero(some).tolist(), key=lambda i: (-scores[i, j], i))[:3])
    assert found(np.full(40, -np.inf)) == want
    assert len(calls) <= 4
    kth = np.sort(scores, axis=0)[-2]  # ruled out: all but the two best of both corpora
    assert found(kth) == [r for r in want if -r[2] >= kth[r[0]]]
    monkeypatch.setattr(bi, "MERGE_ROWS", 1)
    assert found(np.full(40, -np.inf)) == want

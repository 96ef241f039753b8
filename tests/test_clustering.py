"""Mini-batch k-means against full k-means, and its edge cases."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from tessera.operators import clustering as cl
from tessera.operators import models as md

SF = "/root/testdata/sf0.01"


def test_cost_near_the_full_fit(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    clusters, centres, cost = md.pca_minibatch(e, "embedding", "vec_id", 64, k=10, dims=50)
    reduced = md.reduce_vectors(e, "embedding", "vec_id", 64, 50)
    full = min(KMeans(k=10, seed=s, featuresCol="_p", maxIter=50).fit(reduced).summary.trainingCost for s in (42, 43, 44))
    assert cost <= 1.02 * full
    rows = clusters.collect()
    x = np.array([r.reduced for r in rows])
    d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert abs(d.min(1).sum() - cost) < 1e-6 * cost
    assert all(d[i, r.cluster] <= d[i].min() + 1e-9 for i, r in enumerate(rows)) and len(rows) == e.count()


def test_planted_clusters_and_determinism(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 20, (6, 4))
    rows = [(i, [float(v) for v in middles[i % 6] + rng.normal(0, 1, 4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    a, cost = cl.minibatch_centres(df.repartition(5), "id", "v", 4, 6)
    b, _ = cl.minibatch_centres(df.coalesce(1), "id", "v", 4, 6)
    assert np.allclose(a, b) and cost < 900 * 4 * 1.3
    got = {r.id: r.cluster for r in cl.assign(df, "v", a).collect()}
    assert all(got[i] == got[i % 6] for i in got) and len(set(got.values())) == 6


@pytest.mark.parametrize("vectors, n", [([], 0), ([[1.0, 2.0]] * 5, 5), ([[0.0, 0.0], [9.0, 9.0]], 2)])
def test_edges(spark, vectors, n):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>")
    centres, cost = cl.minibatch_centres(df, "id", "v", 2, 10, slices=4)
    assert len(centres) == n and cost == 0.0

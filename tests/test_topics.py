"""The topic fit on planted topics, and its special functions."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import topics as tp


def test_special_functions():
    x = np.array([0.05, 0.125, 0.9, 1.0, 3.7, 6.0, 250.0])
    assert np.allclose(tp.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-9)
    h = 1e-6
    assert np.allclose(tp.digamma(x), [(math.lgamma(v + h * v) - math.lgamma(v - h * v)) / (2 * h * v) for v in x], rtol=1e-5)
    y = np.array([0.01, 0.125, 1.0, 4.2, 77.0, 1e4])
    assert np.allclose(tp.exp_digamma(y), np.exp(tp.digamma(y)), rtol=1e-12, atol=0)


def _planted(n, seed):
    """Documents of mostly one of three topics of twelve words each."""
    rnd = random.Random(seed)
    words = [[f"t{t}w{i:02d}" for i in range(12)] for t in range(3)]
    rows = []
    for i in range(n):
        own = i % 3
        ws = [rnd.choice(words[own] if rnd.random() < 0.9 else rnd.choice(words)) for _ in range(rnd.randint(30, 60))]
        rows.append((i, " ".join(ws)))
    return rows


def test_planted_topics_are_found(spark):
    rows = _planted(240, 4)
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    model = tp.fit_topics(df, "id", "t", k=3, seed=7, stop_words=[], max_df=1.0)
    assert all(b > a - 1e-9 for a, b in zip(model.bounds, model.bounds[1:])), "the bound never falls"
    assert len(model.bounds) < 100 and model.bounds[-1] - model.bounds[-2] < 1e-5
    top = {}
    for r in model.words(12).collect():
        top.setdefault(r.topic, set()).add(r.word[:2])
    assert sorted(map(tuple, top.values())) == [("t0",), ("t1",), ("t2",)]
    name = {t: next(iter(w)) for t, w in top.items()}
    got = {r.id: r for r in model.dominant(df, "id", "t").collect()}
    assert len(got) == 240 and all(name[r.dominant_topic] == f"t{i % 3}" and r.dominant_topic_prob > 0.6 for i, r in got.items())


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(_planted(60, 5), "id long, t string")
    a = tp.fit_topics(df.coalesce(1), "id", "t", k=3, max_iter=3, stop_words=[], max_df=1.0)
    b = tp.fit_topics(df.repartition(5), "id", "t", k=3, max_iter=3, stop_words=[], max_df=1.0)
    assert a.vocab == b.vocab and np.allclose(a.weights, b.weights) and np.allclose(a.bounds, b.bounds)


def test_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "zz zz yy"), ("d", "zz yy yy"), ("e", "zz xx")], "id string, t string")
    model = tp.fit_topics(df, "id", "t", k=4, stop_words=[], min_df=2, max_df=1.0)
    assert model.vocab == ["zz", "yy"]
    got = {r.id: (r.dominant_topic, round(r.dominant_topic_prob, 9)) for r in model.dominant(df, "id", "t").collect()}
    assert got["a"] == got["b"] == (0, 0.25) and len(got) == 5
    one = tp.fit_topics(df, "id", "t", k=1, stop_words=[], min_df=2, max_df=1.0)
    assert {r.dominant_topic_prob for r in one.dominant(df, "id", "t").collect()} == {1.0}
    none = tp.fit_topics(df.limit(0), "id", "t", k=2, stop_words=[])
    assert none.bounds == [] and {r.dominant_topic for r in none.dominant(df, "id", "t").collect()} == {0}


def test_documents_are_fitted_to_their_own_terms():
    rng = np.random.default_rng(3)
    topics = np.exp(tp._log_shares(rng.gamma(1.0, 1.0, (4, 60))))
    x = rng.poisson(0.2, (50, 60)) * (rng.random((50, 1)) < 0.9)
    rows = [np.flatnonzero(r) for r in x]
    batch = pa.RecordBatch.from_pydict({"id": list(range(50)), "v": [{"indices": i.tolist(), "values": r[i].astype(float).tolist()}
                                                                      for i, r in zip(rows, x)]})
    seen = {}
    for ids, terms, counts in tp._padded(batch, 4):
        for i, g in zip(ids.to_pylist(), tp.fit_documents(terms, counts, topics, 0.25)[0]):
            seen[i] = g
    assert len(seen) == 50
    for i, row in enumerate(x):  # one document over all terms, by the plain rounds
        gamma = np.full(4, 0.25) + row.sum() / 4
        for _ in range(tp.DOC_ROUNDS):
            theta = np.exp(tp.digamma(gamma) - tp.digamma(gamma.sum()))
            new = 0.25 + theta * ((row / (theta @ topics)) @ topics.T)
            gamma, moved = new, np.abs(new - gamma).mean()
            if moved <= tp.DOC_CHANGE:
                break
        assert np.allclose(seen[i], gamma, atol=1e-8), i


def test_groups_hold_every_document(spark, monkeypatch):
    df = spark.createDataFrame([*_planted(40, 8), (40, None), (41, "unseen")], "id long, t string").repartition(2)
    model = tp.fit_topics(df, "id", "t", k=3, max_iter=1, stop_words=[], max_df=1.0)
    monkeypatch.setattr(tp, "FIT_CELLS", 1 << 10)
    rows = pa.Table.from_batches(list(tp._groups(iter(model.fitted.toArrow().to_batches()), 3))).to_pylist()
    assert len(rows) > 5
    laid = []
    for r in rows:
        terms, counts = (np.frombuffer(r[c], t).reshape(r["docs"], -1) for c, t in (("terms", np.int32), ("counts", float)))
        assert terms.shape == counts.shape and (r["docs"] == 1 or terms.size * 3 <= 1 << 10)
        laid += [sorted((int(a), float(b)) for a, b in zip(p, q) if b) for p, q in zip(terms, counts)]
    assert sorted(laid) == sorted(sorted(zip(r.v.indices.tolist(), r.v.values.tolist())) for r in model.fitted.collect())


def test_every_core_fits_documents(spark):
    df = spark.createDataFrame(_planted(90, 6), "id long, t string").coalesce(1)
    model = tp.fit_topics(df, "id", "t", k=3, max_iter=4, stop_words=[], max_df=1.0)
    sizes = [r["n"] for r in model.fitted.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and sum(sizes) == 90 and max(sizes) <= 2 * 90 / len(sizes) + 2
    by_id = {r.id: (r.dominant_topic, r.dominant_topic_prob) for r in model.dominant(None, "id").collect()}
    again = {r.id: (r.dominant_topic, r.dominant_topic_prob) for r in model.dominant(df, "id", "t").collect()}
    assert by_id.keys() == again.keys() and all(by_id[i][0] == again[i][0] and abs(by_id[i][1] - again[i][1]) < 1e-9 for i in by_id)

import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    rows = (q.classify(docs, model).join(labels, "doc_id").where(q.held_out(F.col("doc_id")))
            .select("doc_id", "score", "predicted", "quality").collect())
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = s[y == 1], s[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (good >= q.CUT).mean() > 0.95 and (bad < q.CUT).mean() > 0.6
    assert ((s >= 0) & (s <= 1)).all() and all(r.predicted == (r.score >= q.CUT) for r in rows)


def test_same_model_whatever_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = q.train(docs, labels), q.train(docs.repartition(5), labels.repartition(3))
    assert (a.good, a.bad, a.weights) == (b.good, b.bad, b.weights)


def test_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 1)], "doc_id long, quality int")
    df = docs([(1, None), (2, ""), (3, "x " * 500_000), (4, "a b"), (4, "a b"), (None, "a b")])
    out = q.classify(df, q.train(df, labels))
    rows = out.collect()
    assert out.columns.count("score") == 1 and len(rows) == 6
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.text == "a b"}) == 1
    empty = q.train(df.limit(0), labels.limit(0))
    assert {r.score for r in q.classify(df, empty).collect()} == {0.5}
    assert q.classify(df.limit(0), empty).count() == 0


def test_no_jump_at_a_piece(spark):
    """One byte more than a piece changes little, and the end of a text counts."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9))) for _ in range(500)]
    good = " ".join(rng.choice(words, 6000))
    junk = ["".join(rng.choice(list("qxzvjkwpbgfy"), rng.integers(2, 9))) for _ in range(500)]
    model = q.Model(" ".join(rng.choice(words, 2000)).encode(), " ".join(rng.choice(junk, 2000)).encode())
    rows = [model.features(good[:n]) for n in range(q.PIECE - 2, q.PIECE + 40)]
    assert max(abs(a[i] - b[i]) for a, b in zip(rows, rows[1:]) for i in (0, 1)) < 0.02
    clean = good[:3 * q.PIECE]
    spoilt = clean[:-1500] + " ".join(rng.choice(junk, 1500))[:1500]
    assert model.features(spoilt)[1] < model.features(clean)[1] - 0.05


def test_dictionary_larger_than_the_usual_window(spark):
    """Text at the beginning of a large dictionary is still found."""
    rng = np.random.default_rng(1)
    text = " ".join(str(x) for x in rng.integers(0, 1 << 60, 300))
    filler = " ".join(str(x) for x in rng.integers(0, 1 << 60, 200_000))
    with_it, without = q.Model((text + filler).encode(), b""), q.Model(filler.encode(), b"")
    assert with_it._sizes(text.encode())[0] < 0.2 * without._sizes(text.encode())[0]

"""Invariants of the model stages (values are not compared across engines)."""

from pyspark.sql import functions as F

from tessera.operators import models as md

SF = "/root/testdata/sf0.001"


def test_tfidf_embedding_unit_norm(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    e = md.embed_tfidf(d, "text", width=64)
    r = e.select(F.size("embedding").alias("w"),
                 F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n2")).collect()
    assert all(x.w == 64 for x in r)
    assert all(abs(x.n2 - 1.0) < 1e-9 or x.n2 == 0.0 for x in r)


def test_batch_encoder(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, "")], "id long, t string")
    out = md.embed_batches(d, "t", md.hashing_encoder(16), 16, batch_size=64).collect()
    assert len(out[0].embedding) == 16 and sum(out[1].embedding) == 0


def test_kmeans_clusters_deterministic(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    a = md.pca_kmeans(e, "embedding", "vec_id", width=64, k=10, dims=20, seeds=(1, 2))
    b = md.pca_kmeans(e, "embedding", "vec_id", width=64, k=10, dims=20, seeds=(1, 2))
    assert a.count() == e.count()
    assert a.select("cluster").distinct().count() == 10
    assert sorted(a.collect()) == sorted(b.collect())


def test_kmeans_skips_unusable_vectors(spark):
    rows = [(0, None), (1, [1.0]), (2, [1.0, None])] + [(i, [float(i % 2) * 9, 1.0 * i]) for i in range(3, 40)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id for r in md.pca_kmeans(df, "v", "id", width=2, k=2, dims=2, seeds=(1,)).collect()}
    assert got == set(range(3, 40))


def test_one_encoder_for_corpus_and_queries(spark):
    d = spark.createDataFrame([(1, "red apple tree"), (2, "blue sea water"), (3, "red sea"), (4, None)], "id long, t string")
    model = md.fit_tfidf(d, "t", width=64)
    a = {r.id: r.embedding for r in md.encode(model, d, "t").collect()}
    b = md.encode(model, spark.createDataFrame([(9, "red apple tree")], "id long, t string"), "t").first().embedding
    assert b == a[1] and sum(a[4]) == 0.0
    voc = md.fit_vocabulary_tfidf(d, "t", "id", [], min_df=1, max_df=1.0)
    c = md.encode(voc, d, "t").collect()
    assert all(len(r.embedding) == 6 for r in c)


def test_batch_scores_and_chunks(spark):
    calls = []

    def make():
        import numpy as np

        def predict(texts):
            n = np.char.str_len(texts.astype(str)).astype(float)
            return np.stack([n, 10 - n], axis=1)
        return predict
    d = spark.createDataFrame([(1, "abc"), (2, "a b c d e f g"), (3, None), (4, "  ")], "id long, t string")
    s = {r.id: r.scores for r in md.batch_scores(d, "t", make, ["long", "short"]).collect()}
    assert s[1] == [3.0, 7.0] and s[3] is None and not calls
    got = sorted(tuple(r) for r in md.chunked_scores(d, "id", "t", make, ["long", "short"], size=3).collect())
    assert got == [(1, 0, "short", 7.0), (2, 0, "long", 5.0), (2, 1, "long", 5.0), (2, 2, "short", 9.0)]


def test_terms_are_counted_where_they_lie(spark, monkeypatch):
    texts = ["One one two", None, "", "two three three", "x two_2 one", "deux, DEUX"] * 3
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    want = {"one": (9, 6), "two": (6, 6), "three": (6, 3), "two_2": (3, 3), "deux": (6, 3)}
    got = {r.term: (r.n, r.docs) for r in md.vocabulary(d, "id", "t", [], min_df=1, max_df=1.0).collect()}
    assert got == want
    rows = d.select(md.tokens(F.col("t")).alias("ts")).toArrow().to_batches()
    for limit in (1, 4, 1 << 20):  # a document at a time, some, all
        monkeypatch.setattr(md, "COUNT_TOKENS", limit)
        found, blocks = {}, 0
        for b in md._term_numbers(iter(rows)):
            blocks += 1
            for r in b.to_pylist():
                n, docs = found.get(r["term"], (0, 0))
                found[r["term"]] = n + r["n"], docs + r["docs"]
        assert found == want and (blocks == len(rows)) == (limit == 1 << 20)


def test_token_runs_are_the_matches_of_the_pattern(spark):
    odd = ["a", "_", "1", " ", "-", "́", "ͅ", "‍", "Ⓐ", "Ⅷ", "・", "\U0001d49c", "\U0001f44d", "é"]
    d = spark.createDataFrame([(f"ab{x}cd {x}x {x}{y} y{x}\n{x}",) for x in odd for y in odd], "t string")
    same = d.select((F.regexp_extract_all(F.lower("t"), F.lit(md.TOKEN_PATTERN), 0) == md.tokens(F.col("t"))).alias("same"))
    assert same.where("same").count() == len(odd) ** 2


def test_stop_words_within_the_terms_are_not_counted(spark):
    d = spark.createDataFrame([(1, "the cat the dog cat")], "id long, t string")
    v = md.term_counts(d, "t", ["the", "cat"], ["the", "a"], "v").first().v
    assert dict(zip(v.indices.tolist(), v.values.tolist())) == {1: 2.0}

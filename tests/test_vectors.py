import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as vf
from tessera.operators import joins
from tessera.operators import vectors as vo


def _corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, corpus string, embedding array<float>")


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]),
                                ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vf.cosine("a", "b")).collect()] == [1.0, -1.0, 0.0, 0.0]


def test_guard_vector(spark):
    df = spark.createDataFrame([(None,), ([1.0],), ([1.0, 2.0],)], "v array<double>")
    got = [r[0] for r in df.select(vf.guard_vector("v", 2)).collect()]
    assert got == [[0.0, 0.0], [0.0, 0.0], [1.0, 2.0]]


def test_topk_semantics(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]),  # tie: smaller id first
            (3, "a", [0.0, 1.0]), (4, "a", [-1.0, 0.0]),  # opposite: similarity 0, dropped
            (5, "a", None), (6, "b", [1.0, 1.0])]
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    out = vo.similarity_topk(_corpus(spark, rows), q, k=10).orderBy("corpus", "rank").collect()
    got = [(r.corpus, r.rank, r.id, round(r.similarity, 6)) for r in out]
    # id 5 has no vector: not searchable
    assert got == [("a", 1, 1, 1.0), ("a", 2, 2, 1.0), ("a", 3, 3, 0.5),
                   ("b", 1, 6, round((1 / np.sqrt(2) + 1) / 2, 6))]


def test_wrong_width_is_zero_vector(spark):
    rows = [(1, "a", [1.0, 0.0, 5.0]), (2, "a", [0.0, -1.0])]
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<double>")
    got = [(r.id, r.similarity) for r in vo.similarity_topk(_corpus(spark, rows), q, k=5).orderBy("rank").collect()]
    assert got == [(1, 0.5), (2, 0.5)]


def test_search_params():
    import pytest
    vo.check_search_params("x" * 50, 3)
    for text, k in [("", 3), ("   ", 3), ("short", 3), ("x" * 60, 0), ("x" * 60, 51), ("x" * 60, True)]:
        with pytest.raises(ValueError):
            vo.check_search_params(text, k)


def test_topk_matches_brute_force_and_partitioning(spark):
    rng = np.random.default_rng(7)
    vecs = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, "ab"[i % 2], vecs[i].tolist()) for i in range(300)]
    qs = rng.normal(size=(4, 8))
    q = spark.createDataFrame([(j, qs[j].tolist()) for j in range(4)], "query_id long, embedding array<double>")
    corpus = _corpus(spark, rows)
    a = sorted((r.query_id, r.corpus, r.rank, r.id) for r in vo.similarity_topk(corpus, q, 3).collect())
    b = sorted((r.query_id, r.corpus, r.rank, r.id)
               for r in vo.similarity_topk(corpus.repartition(5), q, 3).collect())
    assert a == b
    want = []
    v64 = vecs.astype(np.float64)
    for j in range(4):
        for c in "ab":
            ids = [i for i in range(300) if "ab"[i % 2] == c]
            s = [(-(v64[i] @ qs[j]) / np.linalg.norm(v64[i]) / np.linalg.norm(qs[j]), i) for i in ids]
            want += [(j, c, k + 1, i) for k, (_, i) in enumerate(sorted(s)[:3])]
    assert a == sorted(want)


def test_centroids_and_theme_filter(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [3.0, 0.0]), (3, 1, [0.0, 2.0])],
                               "id long, c int, v array<float>")
    cents = {r.c: list(r.centroid) for r in vo.centroids(df, "c", "v").collect()}
    assert cents == {0: [2.0, 0.0], 1: [0.0, 2.0]}
    kept = sorted(r.id for r in vo.theme_filter(df, "c", "v", [1.0, 0.1], 0.5).collect())
    assert kept == [1, 2]


def test_topic_lookup_fallback(spark):
    df = spark.createDataFrame([("news", 0), ("dev", 7), ("news", 9), ("dev", None)], "corpus string, t int")
    got = [r.topic_name for r in joins.topic_name(df, "corpus", "t").collect()]
    assert got == ["jobs, workers, employees", "agentic, autonomous, workflows", "9", None]


def test_topic_display_order(spark):
    dim = {(r.corpus, r.topic_id): r.display_no for r in joins.topic_dim(spark).collect()}
    for corpus in ("news", "dev"):
        assert sorted(range(8), key=lambda t: dim[corpus, t]) == [6, 5, 7, 4, 1, 2, 0, 3]


def test_search_with_ids_of_any_type(spark):
    """Text ids, ids beyond 2^53 beside null ids, and null corpora."""
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 1.0])], "query_id string, embedding array<double>")
    rows = [("abc1", "a", [1.0, 0.0]), (None, "a", [1.0, 0.0]), ("abc0", "a", [1.0, 0.0]), ("z", None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, corpus string, embedding array<float>").coalesce(1)
    got = sorted((r.query_id, str(r.corpus), r.rank, r.id) for r in vo.similarity_topk(df, q, 2).collect())
    assert got == [("q1", "None", 1, "z"), ("q1", "a", 1, "abc0"), ("q1", "a", 2, "abc1"), ("q2", "None", 1, "z"),
                   ("q2", "a", 1, "abc0"), ("q2", "a", 2, "abc1")]
    big = 2 ** 60
    rows = [(big + 1, "a", [1.0, 0.0]), (None, "a", [1.0, 0.0]), (big, "a", [0.0, 1.0]), (5, "a", None)]
    df = spark.createDataFrame(rows, "id long, corpus string, embedding array<float>").coalesce(1)
    got = [(r.rank, r.id) for r in vo.similarity_topk(df, q.limit(1), 3).orderBy("rank").collect()]
    assert got == [(1, big + 1), (2, big)]


def test_search_refuses_what_it_cannot_answer(spark):
    import pytest
    df = _corpus(spark, [(1, "a", [1.0, 0.0])])
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vo.similarity_topk(df, spark.createDataFrame([(None, [1.0])], "query_id long, embedding array<double>"), 1)
    assert vo.similarity_topk(df, q.limit(0), 1).count() == 0


def test_any_number_of_queries(spark):
    """Several blocks give what one block gives."""
    import numpy as np
    rng = np.random.default_rng(1)
    df = _corpus(spark, [(i, "ab"[i % 2], [float(x) for x in rng.normal(size=8)]) for i in range(300)])
    q = spark.range(50_000).select(F.col("id").alias("query_id"), F.array(*[F.sin(F.col("id") * (j + 1)) for j in range(8)]).alias("embedding"))
    one = vo.similarity_topk(df, q, 2)
    many = vo.similarity_topk(df, q, 2, block_bytes=1 << 20, width=8)
    assert one.count() == 200_000 and one.exceptAll(many).count() == 0 and many.count() == 200_000


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.5],)], "a array<double>")
    assert df.select(vf.argmax("a")).first()[0] == 1
    assert df.select(F.array_max("a")).first()[0] == 0.5


def test_cosine_to_matches_expression(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([3.0, 4.0],), ([0.0, 0.0],), (None,), ([1.0],)],
                               "v array<double>")
    q = [0.6, 0.8]
    got = [r[0] for r in df.select(vf.cosine_to("v", q)).collect()]
    assert [round(x, 12) for x in got] == [0.6, 1.0, 0.0, 0.0, 0.0]
    ref = [r[0] for r in df.select(vf.cosine(vf.guard_vector("v", 2), F.array(F.lit(0.6), F.lit(0.8)))).collect()]
    assert [round(x, 12) for x in ref] == [round(x, 12) for x in got]


def test_topk_carries_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], rng.normal(size=4).astype(np.float32).tolist(), f"t{i}") for i in range(200)]
    corpus = spark.createDataFrame(rows, "id long, corpus string, embedding array<float>, title string")
    q = spark.createDataFrame([(1, rng.normal(size=4).tolist()), (2, rng.normal(size=4).tolist())],
                              "query_id long, embedding array<double>")
    out = vo.similarity_topk(corpus.repartition(3), q, 4, carry=["title"]).collect()
    assert len(out) == 2 * 2 * 4 and all(r.title == f"t{r.id}" for r in out)


def test_topk_with_many_copies_and_queries(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 6))
    base[::3] = base[0]                      # a third of the rows are copies of one vector
    rows = [(i, "ab"[i % 2], base[i].astype(np.float32).tolist()) for i in range(400)]
    qs = rng.normal(size=(40, 6))
    qs[0] = base[0]                          # a query that ties with every copy
    q = spark.createDataFrame([(j, qs[j].tolist()) for j in range(40)], "query_id long, embedding array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # many batches per task
    try:
        got = sorted((r.query_id, r.corpus, r.rank, r.id)
                     for r in vo.similarity_topk(_corpus(spark, rows).repartition(3), q, 5).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    v = np.array([r[2] for r in rows], dtype=np.float64)
    vn = v / np.linalg.norm(v, axis=1)[:, None]
    want = []
    for j in range(40):
        cos = vn @ (qs[j] / np.linalg.norm(qs[j]))
        for c in "ab":
            cand = sorted((-cos[i], i) for i in range(400) if "ab"[i % 2] == c)
            want += [(j, c, n + 1, i) for n, (_, i) in enumerate(cand[:5])]
    assert got == sorted(want)

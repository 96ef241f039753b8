from pyspark.sql import functions as F

from tessera.operators import labels as lb


def test_top_label_threshold(spark):
    names = ["a", "b"]
    df = spark.createDataFrame([([0.5, 0.2],), ([0.4999, 0.1],), ([],), ([0.7, 0.7],)],
                               "s array<double>")
    got = [tuple(r[0]) for r in df.select(lb.top_label(F.col("s"), names, 0.5)).collect()]
    assert got == [("a", 0.5), ("UNSURE", 0.0), ("UNSURE", 0.0), ("a", 0.7)]  # ties: first wins


def test_primary_mapping(spark):
    df = spark.createDataFrame([("a coding tutorial, technical guide",), ("an opinion piece",),
                                ("UNSURE",)], "l string")
    got = [r[0] for r in df.select(lb.primary_from_top(F.col("l"))).collect()]
    assert got == ["TECHNICAL", "NON_TECHNICAL", "UNSURE"]


def test_label_distribution_null_group_half_even(spark):
    rows = [("positive",)] * 1 + [("neutral",)] * 7 + [(None,)] * 0
    df = spark.createDataFrame(rows + [(None,)], "l string")  # 9 rows
    got = {r.l: (r["count"], r.percent) for r in lb.label_distribution(df, "l").collect()}
    assert got == {"positive": (1, 11.11), "neutral": (7, 77.78), None: (1, 11.11)}
    df = spark.createDataFrame([("a",)] * 1 + [("b",)] * 7, "l string")  # 12.5 -> 12.5
    got = {r.l: r.percent for r in lb.label_distribution(df, "l").collect()}
    assert got == {"a": 12.5, "b": 87.5}


def test_agreement_null_never_agrees(spark):
    df = spark.createDataFrame([("x", "x"), (None, None), ("x", "y"), ("y", "y")], "a string, b string")
    assert lb.agreement(df, {"ab": ("a", "b")}).first()["ab"] == 0.5


def test_crosstab_fills_zero(spark):
    df = spark.createDataFrame([("positive", "neutral"), ("positive", None)], "v string, t string")
    got = {r.label: (r.v, r.t) for r in lb.crosstab(df, {"v": "v", "t": "t"}).collect()}
    assert got == {"positive": (2, 0), "neutral": (0, 1)}


def test_chunk_vote_order_and_nulls(spark):
    chunks = spark.createDataFrame(
        [(1, 0, "positive", 0.4), (1, 1, "negative", 0.4),   # tie: positive wins
         (2, 0, "neutral", 0.9)], "id long, chunk_no int, label string, score double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    got = {r.id: (r.roberta_label, r.roberta_pos_score)
           for r in lb.chunk_vote_sentiment(chunks, "id", docs).collect()}
    assert got == {1: ("positive", 0.5), 2: ("neutral", 0.0), 3: (None, None)}


def test_chunked_lexicon_average_counts_empty_chunks(spark):
    lex = spark.createDataFrame([("good", 2.0)], "word string, weight double")
    text = " ".join(["good"] + ["zz"] * 299 + ["zz"])  # chunk 1 scores, chunk 2 has no hits
    df = spark.createDataFrame([(1, text), (2, "   ")], "id long, t string")
    got = {r.id: (r.score, r.label) for r in lb.chunked_lexicon_sentiment(df, "id", "t", lex).collect()}
    one = 2.0 / (4.0 + 15.0) ** 0.5
    assert abs(got[1][0] - one / 2) < 1e-12 and got[1][1] == "positive"
    assert got[2] == (None, "neutral")


def test_lexicon_polarity_defaults(spark):
    lex = spark.createDataFrame([("great", 0.6, 0.75), ("bad", -0.4, 0.6)],
                                "word string, polarity double, subjectivity double")
    df = spark.createDataFrame([(1, "Great and bad"), (2, "nothing here"), (3, None)], "id long, t string")
    got = {r.id: (round(r.tb_polarity, 6), r.tb_sentiment) for r in lb.lexicon_polarity(df, "id", "t", lex).collect()}
    assert got == {1: (0.1, "positive"), 2: (0.0, "neutral"), 3: (0.0, "neutral")}


def test_query_sentiment_reads_first_1000_chars(spark):
    lex = spark.createDataFrame([("great", 0.6, 0.75), ("awful", -0.9, 1.0)],
                                "word string, polarity double, subjectivity double")
    text = "great " + "x" * 1000 + " awful"  # 'awful' lies beyond the first 1000 characters
    q = spark.createDataFrame([(1, text)], "id long, q string")
    r = lb.query_sentiment(q, "id", "q", lex).first()
    assert (r.query_polarity, r.query_sentiment_label) == (0.6, "positive")

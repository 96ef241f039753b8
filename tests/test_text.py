from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import filters as fl
from tessera.schemas import AI_KEYWORDS


def _one(spark, expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_token_counts(spark):
    assert _one(spark, tx.space_token_count("s"), "a  b ") == 4
    assert _one(spark, tx.word_count("s"), "a  b ") == 2
    assert _one(spark, tx.word_count("s"), "a\tb\nc d") == 4
    assert _one(spark, tx.space_token_count("s"), "") == 1
    assert _one(spark, tx.word_count("s"), "") == 0
    assert _one(spark, tx.word_count("s"), None) is None


def test_500_token_bound(spark):
    pred = tx.space_token_count("s") > 500
    assert _one(spark, pred, " ".join(["w"] * 500)) is False
    assert _one(spark, pred, " ".join(["w"] * 501)) is True


def test_keyword_occurrence_and_distinct(spark):
    seven = "x machine learning " * 7
    assert _one(spark, tx.keyword_occurrences("s", AI_KEYWORDS), seven) == 7
    four = "deep learning, neural network, machine learning and artificial intelligence"
    assert _one(spark, tx.keyword_distinct("s", AI_KEYWORDS), four) == 4
    # keywords are lower-cased on both sides ("generative AI" matches)
    assert _one(spark, tx.keyword_distinct("s", AI_KEYWORDS), "Generative AI.") == 1
    # " ai ai " : the spaces overlap, non-overlapping count is 1
    assert _one(spark, tx.keyword_occurrences("s", [" ai "]), " ai ai ") == 1


def test_year_bounds(spark):
    rows = [("2019-05-01",), ("2020-01-01",), ("2025-12-31",), ("2026-01-01",), (None,), ("garbage",)]
    df = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in df.select(fl.year_between(F.col("d"), 2020, 2025)).collect()]
    assert got == [False, True, True, False, None, None]


def test_markdown_to_text(spark):
    md = "Intro\n```py\nx = 1\n```\nuse `code` here ![img](a.png) see [the docs](http://x) <b>bold</b>  end"
    assert _one(spark, tx.markdown_to_text("s"), md) == "Intro use here see the docs bold end"


def test_combined_text_strips_unicode_whitespace(spark):
    df = spark.createDataFrame([(None, "\n body text\t")], "t string, b string")
    assert df.select(tx.combined_text("t", "b", 5)).first()[0] == "bod"
    df = spark.createDataFrame([(None, None)], "t string, b string")
    assert df.select(tx.embedding_text("t", "b")).first()[0] == "No content"


def test_url_fallback(spark):
    df = spark.createDataFrame([(None, "s1"), ("", "s2"), ("http://u", "s3")], "u string, s string")
    got = [r[0] for r in df.select(tx.url_fallback("u", "s", "P/")).collect()]
    assert got == ["P/s1", "P/s2", "http://u"]


def test_polarity_label_cutoffs(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0,), (None,)], "x double")
    inc = [r[0] for r in df.select(tx.polarity_label("x", 0.05, True)).collect()]
    strict = [r[0] for r in df.select(tx.polarity_label("x", 0.05, False)).collect()]
    assert inc == ["positive", "negative", "neutral", "neutral"]
    assert strict == ["neutral", "neutral", "neutral", "neutral"]


def test_chunk_words_sizes(spark):
    for n, want in [(0, []), (1, [1]), (299, [299]), (300, [300]), (301, [300, 1]), (600, [300, 300])]:
        text = " ".join(f"w{i}" for i in range(n))
        got = _one(spark, F.transform(tx.chunk_words("s", 300), lambda c: F.size(c)), text)
        assert got == want, n


def test_chunks_concatenate_back(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet="abc", min_size=1, max_size=3), max_size=700))
    def check(ws):
        text = "  ".join(ws)
        chunks = _one(spark, tx.chunk_words("s", 300), text)
        assert [w for c in chunks for w in c] == text.split()
    check()


def test_unicode_word_boundary(spark):
    pred = fl.like_then_regex(F.col("s"), "ai")
    assert _one(spark, pred, "the ai era") is True
    assert _one(spark, pred, "aiè is a word") is False  # è is a letter
    assert _one(spark, pred, "Main") is False


def test_stem_filter_exact_words(spark):
    df = spark.createDataFrame([("bias and privacy", "pii leak, verified"),
                                ("bias", "pipeline"),  # 'pii' is whole-word only
                                (None, "bias privacy")], "t string, b string")
    kept = fl.stem_filter(df, "t", "b").collect()
    assert [(r.t, r.hits) for r in kept] == [("bias and privacy", 4)]


def test_split_tags(spark):
    assert _one(spark, tx.split_tags("s"), "ai, ml,,") == ["ai", "ml"]


def test_parse_tags_json_and_csv(spark):
    df = spark.createDataFrame([('["ai","ml"]',), ("ai, ml,,",), ('[" ai ", ""]',), (None,)], "s string")
    got = [r[0] for r in df.select(tx.parse_tags("s")).collect()]
    assert got == [["ai", "ml"], ["ai", "ml"], ["ai"], None]


def test_is_blank(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n\t",), ("x",)], "s string")
    assert [r[0] for r in df.select(tx.is_blank("s")).collect()] == [True, True, True, False]


def test_word_regex_escapes_literals(spark):
    # regex metacharacters in a keyword are matched literally
    df = spark.createDataFrame([("uses a.i. daily",), ("uses axixa",), ("c++ rocks",)], "s string")
    got = [r[0] for r in df.select(F.col("s").rlike(tx.word_regex("a.i")), F.col("s").rlike(tx.word_regex("c++"))
                                   .alias("c")).collect()]
    assert got == [True, False, False]
    assert [r[0] for r in df.select(F.col("s").contains("c++")).collect()] == [False, False, True]


def test_word_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(tx.word_counts(F.col("w"))).collect()]
    assert [(x.word, x.n) for x in got[0]] == [("a", 1), ("b", 3)] and got[1] is None and got[2] is None


def test_chunking_is_linear(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("word " * n,)] * 4, "s string").coalesce(1)
        took = []
        for _ in range(3):
            t = time.perf_counter()
            df.select(F.sum(F.size(tx.chunk_words("s", 300)))).collect()
            took.append(time.perf_counter() - t)
        return min(took)
    seconds(10_000)
    assert seconds(400_000) < 30 * seconds(50_000) + 1


def test_strip_ws_takes_every_white_space_and_nothing_else(spark):
    points = [i for i in range(0x3100) if not 0xD800 <= i < 0xE000]
    d = spark.createDataFrame([(i, chr(i)) for i in points], "i int, c string")
    bare = F.concat("c", "c", F.lit("a"), "c", F.lit("b\n"), "c")
    got = {r.i for r in d.where(tx.strip_ws(bare) == F.concat(F.lit("a"), "c", F.lit("b"))).collect()}
    assert got == {ord(c) for c in tx.WHITE_SPACE} == {r.i for r in d.where(F.col("c").rlike(r"(?U)^\s$") | (F.col("c") == "\n")).collect()}
    assert d.select(tx.strip_ws(F.lit(None).cast("string")).alias("s")).first().s is None

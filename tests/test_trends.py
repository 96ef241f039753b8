import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import trends

SCHEMA = "d date, pos double, neg double, topic int, label string"


def _rows(month, n, pos=0.6, neg=0.2, topic=0, label="x"):
    return [(dt.date(2022, month, 1 + i % 27), pos, neg, topic, label) for i in range(n)]


def test_month_group_size_is_strict(spark):
    rows = _rows(1, 5) + _rows(2, 6) + [(None, 0.9, 0.1, 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = trends.sentiment_by_month(df, "d", "pos", "neg", 0.0, 5).collect()
    assert [r.month_released for r in out] == ["2022-02"]


def test_ties_and_thresholds(spark):
    rows = [(dt.date(2022, 3, 1), 0.5, 0.5, 0, "x"),   # tie -> neutral in A6
            (dt.date(2022, 3, 2), 0.6, 0.5, 0, "x"),   # +0.1 exactly at threshold -> neutral
            (dt.date(2022, 3, 3), 0.9, 0.5, 0, "x"),   # positive
            (dt.date(2022, 3, 4), None, 0.5, 0, "x")]  # null -> neutral
    df = spark.createDataFrame(rows, SCHEMA)
    r = trends.sentiment_by_month(df, "d", "pos", "neg", 0.1, 0).first()
    assert (r.positive, r.negative, r.neutral) == (25.0, 0.0, 75.0)
    t = trends.sentiment_by_topic(df, "topic", "pos", "neg").first()
    # ties count in both positive and negative; the null counts in neither
    assert (t.positive, t.negative) == (75.0, 25.0)


def test_shares_sum_to_100(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 100), st.integers(0, 100)),
                    min_size=1, max_size=60))
    def check(xs):
        rows = [(dt.date(2023, m, 1), p / 100, q / 100, 0, "x") for m, p, q in xs]
        out = trends.sentiment_by_month(spark.createDataFrame(rows, SCHEMA), "d", "pos", "neg",
                                        0.0, 0).collect()
        for r in out:
            assert 0 <= r.positive <= 100 and 0 <= r.negative <= 100
            assert abs(r.positive + r.negative + r.neutral - 100) < 1e-9
    check()


def test_topic_and_label_shares(spark):
    rows = _rows(4, 3, topic=1, label="Discussion of AI safety, alignment") + _rows(4, 1, topic=7)
    df = spark.createDataFrame(rows, SCHEMA)
    t = trends.topic_share_by_month(df, "d", "topic", 8, 0).first()
    assert t.topic_1 == 75.0 and t.topic_7 == 25.0 and t.topic_0 == 0.0
    lab = trends.label_share_by_month(df, "d", "label", ["%ai safety%", "%jobs%"], 0,
                                      included=[True, False]).first()
    assert lab.asDict() == {"month_released": "2022-04", "topic_0": 75.0}


def test_month_filter_is_pushed_to_scan(spark, tmpdir_fresh):
    rows = _rows(5, 10)
    spark.createDataFrame(rows, SCHEMA).write.parquet(tmpdir_fresh + "/t")
    df = spark.read.parquet(tmpdir_fresh + "/t")
    plan = trends.sentiment_by_month(df, "d", "pos", "neg")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(d), GreaterThanOrEqual(d," in plan


def test_both_corpora_one_aggregation(spark):
    a = spark.createDataFrame(_rows(6, 7), SCHEMA)
    b = spark.createDataFrame(_rows(6, 9, pos=0.1, neg=0.8), SCHEMA)
    out = trends.sentiment_by_month_both({"news": a, "dev": b}, {"news": "d", "dev": "d"}, "pos", "neg")
    got = {r.corpus: (r.positive, r.negative) for r in out.collect()}
    assert got == {"news": (100.0, 0.0), "dev": (0.0, 100.0)}
    assert out.select(F.col("corpus")).count() == 2

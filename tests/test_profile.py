import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import profile as pf
from tessera.operators import topk


def test_histogram_last_bin_closed_and_counts(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "v double")
    h = {r.bin: r.n for r in pf.histogram(df, F.col("v"), 5).collect()}
    assert h == {0: 2, 1: 2, 2: 1, 3: 0, 4: 1}  # max lands in the last bin
    assert sum(h.values()) == 6


def test_histogram_zero_width(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    h = {r.bin: r.n for r in pf.histogram(df, F.col("v"), 4).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0}


def test_weekly_counts_sunday_end_and_empty_weeks(spark):
    rows = [(dt.datetime(2024, 1, 7, 10),),   # Sunday -> week ending 2024-01-07
            (dt.datetime(2024, 1, 8, 0, 1),),  # Monday -> week ending 2024-01-14
            (dt.datetime(2024, 1, 22, 9),)]    # week ending 2024-01-28; 01-21 is empty
    df = spark.createDataFrame(rows, "ts timestamp")
    got = [(r.week, r.n) for r in pf.weekly_counts(df, "ts").orderBy("week").collect()]
    assert got == [(dt.date(2024, 1, 7), 1), (dt.date(2024, 1, 14), 1), (dt.date(2024, 1, 21), 0),
                   (dt.date(2024, 1, 28), 1)]


def test_summary_matches_pandas(spark):
    import pandas as pd
    xs = [5, 1, 9, 3, 3, 8, 2, 7]
    df = spark.createDataFrame([(x,) for x in xs], "v int")
    r = pf.summary(df, F.col("v")).first()
    d = pd.Series(xs).describe(percentiles=[0.1, 0.25, 0.5, 0.75, 0.9])
    assert r["count"] == 8 and abs(r["std"] - d["std"]) < 1e-12
    for k, p in [("p10", "10%"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("p90", "90%")]:
        assert abs(r[k] - d[p]) < 1e-12


def test_null_profile_long_form(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (3, None), (4, "y")], "a int, b string")
    got = {r.column: (r.missing, r.percent) for r in pf.null_profile(df).collect()}
    assert got == {"a": (1, 25.0), "b": (2, 50.0)}


def test_tag_counts_fill_zero_and_top_ties(spark):
    rows = [(2020, "ai"), (2020, "ai"), (2021, "ml"), (2021, "ai"), (2021, "zz")]
    df = spark.createDataFrame(rows, "year int, tag string")
    top = [r.tag for r in topk.top_counts(df, "tag", 2).collect()]
    assert top == ["ai", "ml"]  # tie between ml and zz broken by value
    long = {(r.year, r.tag): r.n for r in topk.counts_by_top(df, "year", "tag", 2).collect()}
    assert long == {(2020, "ai"): 2, (2020, "ml"): 0, (2021, "ai"): 1, (2021, "ml"): 1}


def test_duplicate_profile(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert pf.duplicate_profile(df, "k").first().asDict() == {"rows": 3, "distinct_keys": 2, "duplicates": 1}


def test_empty_inputs_do_not_fail(spark):
    from tessera.operators import labels as lb
    from tessera.operators import trends
    empty = spark.createDataFrame([], "a int, b string")
    assert [(r.column, r.missing, r.percent) for r in pf.null_profile(empty).collect()] == [
        ("a", 0, None), ("b", 0, None)]
    assert pf.histogram(empty, F.col("a"), 4).count() == 0
    zero = spark.createDataFrame([(1, 0, "positive", 0.0)], "id long, chunk_no int, label string, score double")
    assert lb.chunk_vote_sentiment(zero, "id").first().roberta_label is None
    per = spark.createDataFrame([(0, 0.0, 0.0)], "t int, positive double, negative double")
    assert trends.sentiment_all_topics(per).first().positive_share is None


def test_counts_by_top_real_tags(spark):
    rows = [(2020, "node.js"), (2020, "node.js"), (2021, None), (2021, None), (2021, "x")]
    df = spark.createDataFrame(rows, "year int, tag string")
    got = {(r.year, r.tag): r.n for r in topk.counts_by_top(df, "year", "tag", 2).collect()}
    assert got == {(2020, "node.js"): 2, (2020, None): 0, (2021, "node.js"): 0, (2021, None): 2}
    assert topk.counts_by_top(df.limit(0), "year", "tag", 2).count() == 0
    wide = {r.year: (r.node, r.other) for r in topk.counts_by_values(
        df, "year", "tag", {"node": "node.js", "other": "y"}).collect()}
    assert wide == {2020: (2, 0), 2021: (0, 0)}


def test_summary_needs_no_single_buffer(spark):
    import numpy as np
    xs = [float(x) for x in np.random.default_rng(1).normal(size=500)] + [1.5] * 300
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "v double").repartition(5)
    r = pf.summary(df, F.col("v")).first()
    assert r["count"] == 800 and abs(r["std"] - np.std(xs, ddof=1)) < 1e-9
    for p in (10, 25, 50, 75, 90):
        assert abs(r[f"p{p}"] - np.percentile(xs, p)) < 1e-12
    assert abs(pf.iqr(df, F.col("v")).first()[0] - (np.percentile(xs, 75) - np.percentile(xs, 25))) < 1e-12
    empty = pf.summary(df.limit(0), F.col("v")).first()
    assert empty["count"] == 0 and empty["p50"] is None and empty["std"] is None

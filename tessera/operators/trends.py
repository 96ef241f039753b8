"""Dashboard trend queries: shares per topic, per month and per label.

All percentages come from integer counts (``count_if``) divided once, so
both engines produce identical doubles.  Every query is one hash
aggregation with map-side partial aggregation: a hot month or topic is
pre-combined in every task before the shuffle, so skew does not
concentrate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pct(n: Column, total: Column) -> Column:
    return n * F.lit(100.0) / total


def month_range(date_col: str, start: str, end: str) -> Column:
    """Half-open range on the raw date/timestamp: ``start``-``end`` inclusive
    as ``yyyy-MM`` months.  A range predicate reaches the Parquet scan; a
    formatted-string predicate would not."""
    lo = F.to_date(F.lit(start + "-01"))
    hi = F.add_months(F.to_date(F.lit(end + "-01")), 1)
    c = F.col(date_col)
    return (c >= lo) & (c < hi)


def month_key(date_col: str) -> Column:
    return F.trunc(F.col(date_col), "month")


def sentiment_by_month(df: DataFrame, date_col: str, pos_col: str, neg_col: str,
                       threshold: float = 0.0, min_posts: int = 5,
                       start: str = "2021-01", end: str = "2025-12",
                       by: list[str] | None = None) -> DataFrame:
    """Monthly positive / negative / neutral share of posts.

    positive: ``pos - neg > threshold``; negative: ``pos - neg < -threshold``
    (strict, so exact ties are neutral); a null score is neutral.  Months
    with ``count <= min_posts`` are dropped.  Rows without a date fall
    outside the range and are dropped.
    """
    if threshold < 0:
        raise ValueError("threshold must be >= 0")
    by = list(by or [])
    net = F.col(pos_col) - F.col(neg_col)
    g = (df.where(month_range(date_col, start, end))
           .groupBy(*by, month_key(date_col).alias("_m"))
           .agg(F.count(F.lit(1)).alias("_n"),
                F.count_if(net > F.lit(float(threshold))).alias("_pos"),
                F.count_if(net < F.lit(-float(threshold))).alias("_neg"))
           .where(F.col("_n") > min_posts))
    pos = _pct(F.col("_pos"), F.col("_n"))
    neg = _pct(F.col("_neg"), F.col("_n"))
    return g.select(*by, F.date_format("_m", "yyyy-MM").alias("month_released"),
                    pos.alias("positive"), neg.alias("negative"),
                    (F.lit(100.0) - pos - neg).alias("neutral"))


def sentiment_by_month_both(frames: dict[str, DataFrame], date_cols: dict[str, str],
                            pos_col: str, neg_col: str, **kw) -> DataFrame:
    """The same monthly sentiment for several corpora side by side.

    The corpora are projected to the four needed columns, tagged with a
    ``corpus`` literal and unioned, so one aggregation serves all of them.
    """
    parts = [f.select(F.lit(name).alias("corpus"), F.col(date_cols[name]).alias("_date"),
                      F.col(pos_col).alias("_p"), F.col(neg_col).alias("_q"))
             for name, f in frames.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return sentiment_by_month(u, "_date", "_p", "_q", by=["corpus"], **kw)


def sentiment_by_topic(df: DataFrame, topic_col: str, pos_col: str, neg_col: str,
                       topic: int = -1) -> DataFrame:
    """Percent positive (``pos - neg >= 0``) and negative (``<= 0``) per topic.

    Ties at exactly 0 count in both.  ``topic = -1`` keeps every non-null
    topic; otherwise only that one.  Null scores count in neither.
    """
    t = F.col(topic_col)
    pred = t.isNotNull() & (t != F.lit(-1)) if topic == -1 else (t == F.lit(topic))
    net = F.col(pos_col) - F.col(neg_col)
    return (df.where(pred).groupBy(t.alias(topic_col))
              .agg(F.count(F.lit(1)).alias("_n"),
                   F.count_if(net >= 0).alias("_pos"),
                   F.count_if(net <= 0).alias("_neg"))
              .select(topic_col, _pct(F.col("_pos"), F.col("_n")).alias("positive"),
                      _pct(F.col("_neg"), F.col("_n")).alias("negative")))


def sentiment_all_topics(per_topic: DataFrame) -> DataFrame:
    """"All topics" roll-up: the sum of per-topic percentages (macro), plus
    the same two numbers normalised to shares of their total."""
    s = per_topic.agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))
    tot = F.col("positive") + F.col("negative")
    return s.select("positive", "negative",
                    F.try_divide(F.col("positive") * 100.0, tot).alias("positive_share"),
                    F.try_divide(F.col("negative") * 100.0, tot).alias("negative_share"))


def topic_share_by_month(df: DataFrame, date_col: str, topic_col: str, n_topics: int = 8,
                         min_posts: int = 5) -> DataFrame:
    """Monthly share (percent) of each topic id ``0..n_topics-1``; months with
    ``count <= min_posts`` dropped; rows without a date dropped."""
    aggs = [F.count_if(F.col(topic_col) == i).alias(f"_t{i}") for i in range(n_topics)]
    g = (df.where(F.col(date_col).isNotNull())
           .groupBy(month_key(date_col).alias("_m"))
           .agg(F.count(F.lit(1)).alias("_n"), *aggs)
           .where(F.col("_n") > min_posts))
    return g.select(F.date_format("_m", "yyyy-MM").alias("month_released"),
                    *[_pct(F.col(f"_t{i}"), F.col("_n")).alias(f"topic_{i}")
                      for i in range(n_topics)])


def label_share_by_month(df: DataFrame, date_col: str, label_col: str, patterns: list[str],
                         min_posts: int = 50, included: list[bool] | None = None) -> DataFrame:
    """Monthly share of rows whose label matches each case-insensitive LIKE
    pattern.  The denominator is every row of the month (unmatched labels
    included).  ``included`` selects which series to return; unselected
    series are not computed at all."""
    included = included or [True] * len(patterns)
    if len(included) != len(patterns):
        raise ValueError("included must have one flag per pattern")
    lab = F.col(label_col)
    aggs = [F.count_if(lab.ilike(p)).alias(f"_t{i}")
            for i, (p, keep) in enumerate(zip(patterns, included)) if keep]
    g = (df.where(F.col(date_col).isNotNull())
           .groupBy(month_key(date_col).alias("_m"))
           .agg(F.count(F.lit(1)).alias("_n"), *aggs)
           .where(F.col("_n") > min_posts))
    return g.select(F.date_format("_m", "yyyy-MM").alias("month_released"),
                    *[_pct(F.col(f"_t{i}"), F.col("_n")).alias(f"topic_{i}")
                      for i, keep in enumerate(included) if keep])


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``value_counts().sort_index()``: rows per key value."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(name)

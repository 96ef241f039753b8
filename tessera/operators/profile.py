"""Profiling: lengths, summaries, histograms, null profiles, time series.

Global statistics that later steps need as constants (histogram bounds,
the first and last week) are one-row aggregates fetched as scalars -- a
bounded two-number result, never the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text as tx
from tessera.schemas import CONCEPT_PATTERNS
from tessera.session import checkpoint_dir

SUMMARY_PERCENTILES = [0.1, 0.25, 0.5, 0.75, 0.9]


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """(v, c): distinct non-null values with their counts, checkpointed, so the
    input is scanned once whatever is computed from them.  The null test is on
    the counted table: in front of it, it would evaluate ``value`` twice."""
    counted = df.select(value.cast("double").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    checkpoint_dir(df.sparkSession)
    return counted.checkpoint().where(F.col("v").isNotNull())


def _percentiles(counts: DataFrame, n: int, fractions: list[float]) -> list[float | None]:
    """Exact percentiles by linear interpolation from a (value, count) table.

    The values are sorted by range across tasks; only the row count of each
    range goes to the driver, and one aggregation then picks the values at the
    wanted ranks.
    """
    if not n:
        return [None] * len(fractions)
    ranged = counts.repartitionByRange("v").select("v", "c", F.spark_partition_id().alias("part")).checkpoint()
    sums = sorted((r["part"], r["c"]) for r in ranged.groupBy("part").agg(F.sum("c").alias("c")).collect())
    base, total = F.lit(0), 0
    for part, c in sums:
        base = F.when(F.col("part") == part, F.lit(total)).otherwise(base)
        total += c
    order = Window.partitionBy("part").orderBy("v")
    cum = ranged.select("v", (F.sum("c").over(order) + base).alias("upto"))
    ranks = [(n - 1) * f for f in fractions]
    wanted = sorted({r for x in ranks for r in (math.floor(x), math.ceil(x))})
    row = cum.agg(*[F.min(F.when(F.col("upto") > r, F.col("v"))).alias(str(r)) for r in wanted]).first()
    out = []
    for x in ranks:
        lo, hi = row[str(math.floor(x))], row[str(math.ceil(x))]
        out.append(lo + (hi - lo) * (x - math.floor(x)))
    return out


def summary(df: DataFrame, value: Column, percentiles: list[float] = SUMMARY_PERCENTILES) -> DataFrame:
    """count, mean, sample std, min, percentiles (linear interpolation), max;
    one scan of the input, no task that holds all values."""
    counts = value_counts(df, value)
    n, mean, lo, hi = counts.agg(F.sum("c"), F.sum(F.col("v") * F.col("c")) / F.sum("c"), F.min("v"),
                                 F.max("v")).first()
    n = n or 0
    std = None
    if n > 1:
        square = (F.col("v") - F.lit(mean)) * (F.col("v") - F.lit(mean)) * F.col("c")
        std = math.sqrt(counts.agg(F.sum(square)).first()[0] / (n - 1))
    names = [f"p{int(round(x * 100))}" for x in percentiles]
    schema = ", ".join(["count long", "mean double", "std double", "min double", *[f"{x} double" for x in names],
                        "max double"])
    return df.sparkSession.createDataFrame(
        [(n, mean, std, lo, *_percentiles(counts, n, percentiles), hi)], schema)


def iqr(df: DataFrame, value: Column) -> DataFrame:
    counts = value_counts(df, value)
    a, b = _percentiles(counts, counts.agg(F.sum("c")).first()[0] or 0, [0.25, 0.75])
    return df.sparkSession.createDataFrame([(None if a is None else b - a,)], "iqr double")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed, like
    ``numpy.histogram``; every bin is returned, empty ones with 0.  A constant
    column puts everything in bin 0.

    The input is scanned once: rows collapse to (value, count) pairs
    (partial aggregation), which are checkpointed -- few rows for integer
    measures such as word counts -- and both the bounds and the bins are
    computed from that small table.
    """
    spark = df.sparkSession
    vc = value_counts(df, value)
    lo, hi = vc.agg(F.min("v"), F.max("v")).first()
    if lo is None:
        return spark.range(0).select(F.col("id").cast("int").alias("bin"),
                                     F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
                                     F.lit(0).cast("bigint").alias("n"))
    width = (hi - lo) / bins
    if hi > lo:
        b = F.least(F.floor((F.col("v") - F.lit(lo)) * F.lit(float(bins)) / F.lit(hi - lo)),
                    F.lit(bins - 1)).cast("int")
    else:
        b = F.lit(0)
    counts = vc.groupBy(b.alias("bin")).agg(F.sum("c").alias("n"))
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (edges.join(counts, "bin", "left")
                 .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                         F.coalesce("n", F.lit(0).cast("bigint")).alias("n")))


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count and percent per column, long form, in one pass."""
    cols = cols or df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in cols])).alias("x"))
    return long.select("x.column", "x.missing",
                       (F.try_divide(F.col("x.missing"), F.col("_n")) * 100.0).alias("percent"))


def null_matrix(df: DataFrame, order: list[str], n: int = 100, cols: list[str] | None = None) -> DataFrame:
    """``isnull`` flags of the first ``n`` rows by ``order`` (a preview)."""
    cols = cols or df.columns
    return df.orderBy(*order).limit(n).select(
        *order, *[F.col(c).isNull().alias(f"{c}_null") for c in cols if c not in order])


def weekly_counts(df: DataFrame, ts_col: str) -> DataFrame:
    """Rows per week, weeks ending on Sunday (labelled by that Sunday), with
    empty weeks between the first and last as 0."""
    week_end = F.date_add(F.to_date(F.date_trunc("week", F.col(ts_col))), 6)
    counts = df.where(F.col(ts_col).isNotNull()).groupBy(week_end.alias("week")).agg(
        F.count(F.lit(1)).alias("n"))
    # One row per week is left: each fills the gap up to the next one.
    following = F.lead("week").over(Window.orderBy("week"))
    until = F.coalesce(F.date_sub(F.col("next"), 7), F.col("week"))
    filled = counts.withColumn("next", following).select(
        "week", "n", F.explode(F.sequence("week", until, F.expr("INTERVAL 7 DAYS"))).alias("at"))
    return filled.select(F.col("at").alias("week"),
                         F.when(F.col("at") == F.col("week"), F.col("n")).otherwise(F.lit(0).cast("bigint")).alias("n"))


def word_stats_by_year(df: DataFrame, ts_col: str, text_col: str) -> DataFrame:
    """Mean whitespace word count per year."""
    return (df.where(F.col(ts_col).isNotNull() & F.col(text_col).isNotNull())
              .groupBy(F.year(ts_col).alias("year_released"))
              .agg(F.avg(tx.word_count(text_col)).alias("avg_words")))


def concept_mentions(df: DataFrame, ts_col: str, text_col: str,
                     patterns: dict[str, str] = CONCEPT_PATTERNS) -> DataFrame:
    """Rows per year whose lower-cased text matches each regex (Unicode-aware)."""
    low = F.lower(F.col(text_col))
    return (df.where(F.col(ts_col).isNotNull() & F.col(text_col).isNotNull())
              .groupBy(F.year(ts_col).alias("year_released"))
              .agg(*[F.count_if(low.rlike("(?U)" + p)).alias(name) for name, p in patterns.items()]))


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and duplicate rows of a key.  Keys are compared by a
    256-bit hash, so no long key enters a shuffle."""
    hashed = df.select(F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("k"))
    g = hashed.groupBy("k").agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), F.count("k").alias("distinct_keys"))
    return g.select("rows", "distinct_keys", (F.col("rows") - F.col("distinct_keys")).alias("duplicates"))


def date_range(df: DataFrame, ts_col: str) -> DataFrame:
    return df.agg(F.min(ts_col).alias("first"), F.max(ts_col).alias("last"))

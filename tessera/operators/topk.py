"""Global top-k by count and the operators built on it.

``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: every task keeps
its own k best rows and only those reach the final merge.  The k winning
keys are at most k rows, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


def top_counts(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of ``key`` (ties by value), with counts."""
    return (rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("n"), F.asc(key)).limit(k))


def semi_join_top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose ``key`` is among the ``k`` most frequent."""
    top = top_counts(rows, key, k).select(key)
    return rows.join(F.broadcast(top), key, "left_semi")  # at most k rows


def counts_by_top(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """``group`` x top-``k`` ``key`` counts, long form (group, key, n), missing
    pairs of a group that holds any of the keys as 0.  The input is scanned
    once; a null key counts as a key."""
    checkpoint_dir(rows.sparkSession)
    counted = rows.groupBy(group, key).agg(F.count(F.lit(1)).alias("n")).checkpoint()
    top = (counted.groupBy(key).agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), F.asc(key)).limit(k)
           .select(F.col(key).alias("_key")))
    kept = counted.join(F.broadcast(top), F.col(key).eqNullSafe(F.col("_key")), "left_semi")  # at most k rows
    values = [r["_key"] for r in top.collect()]  # at most k values
    if not values:
        return kept
    typed = F.array(*[F.lit(v) for v in values]).cast(f"array<{dict(rows.dtypes)[key]}>")
    every = kept.select(F.col(group).alias("_group")).distinct().select("_group", F.explode(typed).alias("_key"))
    both = every.join(kept, F.col(group).eqNullSafe(F.col("_group")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return both.select(F.col("_group").alias(group), F.col("_key").alias(key),
                       F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def counts_by_values(rows: DataFrame, group: str, key: str, values: dict[str, str]) -> DataFrame:
    """One column per wanted value of ``key``: ``values`` maps column names to
    values, so no column name comes from the data; one partial aggregation."""
    return rows.groupBy(group).agg(*[F.count_if(F.col(key) == F.lit(v)).alias(name) for name, v in values.items()])


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Global first ``n`` rows by ``order`` (end the order with a unique key)."""
    return df.orderBy(*order).limit(n)

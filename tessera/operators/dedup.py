"""Keep-first / keep-last, quotas, first-n per group, upsert.

Keep-first and keep-last are aggregations (``min``/``max`` over a struct
whose leading fields are the ordering), so every task pre-combines its
rows before the shuffle: a key holding a third of the data shrinks to one
row per task.  First-n-per-group uses ``row_number`` and relies on
Spark's WindowGroupLimit, which applies the limit per task before the
shuffle as well.  Orderings must end with a unique column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _pick(df: DataFrame, keys: list[Column | str], order: list[str], fn) -> DataFrame:
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    key_names = [k if isinstance(k, str) else f"_k{i}" for i, k in enumerate(keys)]
    payload = [c for c in df.columns if c not in key_names]
    s = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                 F.struct(*payload).alias("_row"))
    g = df.groupBy(*[c.alias(n) for c, n in zip(key_cols, key_names)]).agg(fn(s).alias("_m"))
    keep = [n for n in key_names if isinstance(n, str) and n in df.columns]
    return g.select(*keep, "_m._row.*")


def keep_first(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order`` (ascending, nulls first)."""
    return _pick(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """One row per key: the largest by ``order``."""
    return _pick(df, keys, order, F.max)


def first_n(df: DataFrame, partition: list[Column | str], order: list[Column], n: int,
            rank_col: str | None = None) -> DataFrame:
    """The first ``n`` rows per group by ``order`` (``row_number() <= n``)."""
    if n < 1:
        raise ValueError("n must be >= 1")
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col) if rank_col else out.drop("_rn")


def quota_size(max_items: int, n_groups: int) -> int:
    """Per-group quota: an equal share plus ``n_groups`` slack."""
    return max_items // n_groups + n_groups


def dedup_prefix(df: DataFrame, text_col: str, group_cols: list[str], order: list[str],
                 prefix_len: int = 50) -> DataFrame:
    """Keep the first row per (group, first ``prefix_len`` chars of text)."""
    return keep_first(df, [*group_cols, F.substring(F.col(text_col), 1, prefix_len)], order)


def upsert_latest(existing: DataFrame, updates: DataFrame, keys: list[str],
                  order_col: str | None = None) -> DataFrame:
    """Insert-or-replace by primary key: an update replaces every non-key column.

    Within ``updates`` the row with the largest ``order_col`` wins (e.g. batch
    id then position); without it, updates must be unique per key.
    """
    cols = existing.columns
    e = existing.select(*cols, F.lit(0).alias("_v"), F.lit(None).cast("long").alias("_seq"))
    u = updates.select(*cols, F.lit(1).alias("_v"),
                       (F.col(order_col).cast("long") if order_col else F.lit(0).cast("long"))
                       .alias("_seq"))
    merged = keep_last(e.unionByName(u), keys, ["_v", "_seq"])
    return merged.select(*cols)


def check_constraints(df: DataFrame, keys: list[str], not_null: list[str]) -> DataFrame:
    """Violation counts of a primary key and NOT NULL columns in one
    aggregation: rows with a null key part, nulls per column, and key
    duplicates (non-null keys minus distinct keys)."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    null_aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null]
    out = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_null).alias("null_key"),
                 *null_aggs, F.count_distinct(*[F.col(k) for k in keys]).alias("_d"))
    return out.select("rows", "null_key", *[f"null_{c}" for c in not_null],
                      (F.col("rows") - F.col("null_key") - F.col("_d")).alias("duplicate_keys"))

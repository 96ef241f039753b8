"""Sinks: CSV and Parquet with overwrite / append / truncate-and-load.

Writes go through Spark's commit protocol (task output is renamed into
place only on job commit), so a lost executor never leaves a half-written
table visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Replace (``overwrite``) or extend (``append``) a Parquet table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_all(frames: list[DataFrame], path: str) -> None:
    """Drop-then-append of several inputs as one overwrite of their union."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    write_table(u, path, "overwrite")


def truncate_and_load(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace the rows but keep the target's schema (columns, order, types)."""
    target = spark.read.parquet(path).schema
    out = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in target.fields])
    out.write.mode("overwrite").parquet(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a written table, read back (checks what was committed)."""
    return spark.read.parquet(path).count()


def write_table_counted(df: DataFrame, path: str, mode: str = "overwrite",
                        partition_by: list[str] | None = None) -> int:
    """Write like ``write_table`` and return the number of rows written,
    measured during the write with ``DataFrame.observe`` (no second scan)."""
    obs = Observation("written")
    write_table(df.observe(obs, F.count(F.lit(1)).alias("rows")), path, mode, partition_by)
    return int(obs.get["rows"])


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, path: str) -> DataFrame:
    """Write a table hashed into ``buckets`` by ``keys`` and sorted by them in
    each, and read it back.  Joins and aggregations by these keys between
    tables of the same number of buckets need no exchange.  One file per bucket
    is written (the rows are dealt out once, here), so size buckets to fit a
    task."""
    parts = df.repartition(buckets, *keys)
    parts.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)

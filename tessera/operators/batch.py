"""Run one job over several tables and report which ones completed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_for_tables(spark: SparkSession, tables: list[str], job: Callable[[str], int]) -> DataFrame:
    """Call ``job(table)`` for each table name (each call is its own
    distributed Spark job, e.g. embed and overwrite), catching failures so
    one bad table does not stop the rest.  Returns (table, ok, rows, error)
    with ``rows`` the job's reported row count."""
    if not tables:
        raise ValueError("at least one table is required")
    out = []
    for t in tables:
        try:
            out.append((t, True, int(job(t)), None))
        except Exception as e:  # reported per table, not raised
            out.append((t, False, None, f"{type(e).__name__}: {e}"[:1000]))
    return spark.createDataFrame(out, "table string, ok boolean, rows long, error string")

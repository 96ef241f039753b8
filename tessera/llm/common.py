"""Helpers shared by the pipeline operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

ROW = "__row"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a fresh folder under the shared checkpoint folder and
    read it back: cuts lineage, survives lost executors and gives the planner
    real sizes.  The job's owner empties the checkpoint folder."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(df: DataFrame) -> DataFrame:
    """The input columns as one struct, so that no column an operator adds
    can clash with one of the input's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpack(df: DataFrame, columns: list[str], **made: Column) -> DataFrame:
    """Input columns again, with the operator's own columns added; a made
    column replaces an input column of the same name."""
    kept = [F.col(ROW)[c].alias(c) for c in columns if c not in made]
    return df.select(*kept, *[v.alias(k) for k, v in made.items()])


def text_of(name: str = "text") -> Column:
    """A text column of a packed row; null counts as empty."""
    return F.coalesce(F.col(ROW)[name], F.lit(""))

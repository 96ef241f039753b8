"""Mixing sources to target weights by repetition rates.

Tokens are summed per source, targets are shared out by weight under a cap on
repetition, and a document is emitted floor(rate) times plus one more time with
probability equal to the fraction, decided by a hash of its id and text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ROW, pack, stage, text_of, unpack

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2


def _numbered(sources: DataFrame) -> DataFrame:
    """``n``: position from 0 in the order of code points, null last.  Sorted
    by range, so that no task holds all sources; only the row count of each
    range goes to the driver."""
    ranged = stage(sources.repartitionByRange(F.col("source").isNull(), "source")
                   .select("*", F.spark_partition_id().alias("part")))
    counts = sorted((r["part"], r["c"]) for r in ranged.groupBy("part").agg(F.count("*").alias("c")).collect())
    base, offset = F.lit(0), 0
    for part, c in counts:
        base = F.when(F.col("part") >= part, F.lit(offset)).otherwise(base)
        offset += c
    w = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ranged.select("*", (F.row_number().over(w) - 1 + base).alias("n")).drop("part")


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                 max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    ``share`` times all tokens is dealt by weight; a target above
    ``max_repeat`` times its source's size is cut to that, and the excess is
    dealt again by weight among the others until none is above.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weight = F.lit(weights[-1])
    k = len(weights)
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("n") % k == i, F.lit(w)).otherwise(weight)
    table = stage(_numbered(sums).select("source", "source_size", weight.cast("long").alias("weight"),
                                         (F.col("source_size") * max_repeat).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    want = min(share, max_repeat) * total
    level, capped = 0.0, -1
    while True:  # each pass raises the level, so the set of capped sources only grows
        at_cap = F.col("cap") <= F.col("weight") * F.lit(level)
        caps, n, open_weight = table.agg(F.sum(F.when(at_cap, F.col("cap"))), F.count(F.when(at_cap, 1)),
                                         F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (want - (caps or 0)) / open_weight
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return table.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def draw(key: Column, text: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of ``key`` (null: as the text 'null') and ``text``."""
    hexed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))
    return F.conv(F.substring(hexed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT,
        seed: int = 0) -> DataFrame:
    """One row per input row with ``size`` (words), ``source_size``,
    ``target``, ``copies`` and ``taken`` (words the mix takes).

    Defined cases: null text has size 0; a null source is a source of its own,
    last in order; a source of size 0 has target 0 and rate 0; rows equal in id
    and text get the same draw, so repeated rows are decided alike; rows of one
    id, or without id, whose texts differ draw apart; an empty table gives an
    empty result.  Input columns of the same names
    are replaced.
    """
    sized = pack(docs).select(ROW, F.col(ROW)[source_col].alias("source"),
                              F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
                              draw(F.col(ROW)[id_col], text_of(text_col), seed).alias("draw"))
    rates = source_rates(sized.select("source", "size"), weights, share, max_repeat)
    rates = rates.withColumnRenamed("source", "of")
    rated = sized.join(rates, F.col("source").eqNullSafe(F.col("of")), "left")
    fraction = F.col("rate") - F.floor("rate")
    copies = (F.floor("rate") + (F.col("draw") < fraction).cast("long")).cast("long")
    return unpack(rated.select(ROW, "size", "source_size", "target", copies.alias("copies")), docs.columns,
                  size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"),
                  copies=F.col("copies"), taken=F.col("copies") * F.col("size"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says, numbered by ``copy``."""
    return mixed.where(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))

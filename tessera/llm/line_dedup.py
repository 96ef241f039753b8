"""Line deduplication over overlapping three-line windows.

Every run of three consecutive lines is hashed (128 bits), windows that occur
more than once in the corpus are found with one partial aggregation, and each
occurrence but the first loses its lines; overlapping windows are merged by
taking the union of the covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ROW, pack, text_of, unpack

WINDOW = 3


def _window_hashes(lines: Column, size: int) -> Column:
    def hashed(_, i):
        run = [F.get(lines, i + k) for k in range(size)]
        blank = F.lit(True)
        for x in run:
            blank = blank & F.trim(x).eqNullSafe("")
        full = i + F.lit(size) <= F.size(lines)
        return F.when(full & ~blank, F.struct(F.xxhash64(*run).alias("h"), F.xxhash64(F.lit(size), *run).alias("g"),
                                              i.alias("pos")))
    return F.filter(F.transform(lines, hashed), lambda w: w.isNotNull())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                window: int = WINDOW) -> DataFrame:
    """Remove later occurrences of repeated windows of ``window`` lines.

    Returns the input's columns with the text rewritten, plus ``n_lines``
    (before) and ``n_removed``.  Lines are the pieces between ``\\n``, compared
    byte by byte.  The first occurrence is the one with the smallest id (nulls
    last), then the smallest position.  Defined cases: null text counts as
    empty (one empty line) and stays null; documents of fewer than ``window``
    lines and windows of blank lines only are left alone; rows equal in id and
    text are one document and get the same result, so repeating a row removes
    nothing by itself; rows with one id and different texts (null ids as well)
    are different documents.  Input columns named like a result column are
    replaced by it.
    """
    packed = pack(docs).select(ROW, text_of(text_col).alias("t"))
    keyed = packed.select(ROW, F.col(ROW)[id_col].alias("id"), F.xxhash64("t").alias("th"),
                          F.split("t", "\n", -1).alias("lines"))
    occ = (keyed.where(F.size("lines") >= window)
           .select("id", "th", F.explode(_window_hashes(F.col("lines"), window)).alias("w"))
           .select("w.h", "w.g", F.struct(F.col("id").isNull().alias("last"), "id", "th",
                                          F.col("w.pos").alias("pos")).alias("at")))
    repeated = (occ.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("end"))
                .where(~F.col("first").eqNullSafe(F.col("end"))).select("h", "g", "first"))
    gone = (occ.join(repeated, ["h", "g"])
            .where(~F.col("at").eqNullSafe(F.col("first")))
            .groupBy(F.col("at.id").alias("gid"), F.col("at.th").alias("gth"))
            .agg(F.collect_set("at.pos").alias("begins")))
    covered = F.flatten(F.transform("begins", lambda p: F.sequence(p, p + F.lit(window - 1))))
    gone = gone.select("gid", "gth", F.array_distinct(covered).alias("cover"))
    both = keyed.join(gone, F.col("id").eqNullSafe(F.col("gid")) & (F.col("th") == F.col("gth")), "left")
    kept = both.select(ROW, "lines", "cover",
                       F.when(F.col("cover").isNotNull(),
                              F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("cover"))).alias("kept"))
    text = F.when(F.col("kept").isNull(), F.col(ROW)[text_col]).otherwise(
        F.array_join(F.transform("kept", lambda i: F.get(F.col("lines"), i)), "\n"))
    return unpack(kept, docs.columns, **{text_col: text},
                  n_lines=F.size("lines").cast("long"),
                  n_removed=F.when(F.col("cover").isNull(), 0).otherwise(F.size("cover")).cast("long"))

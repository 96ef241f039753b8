"""Mini-batch k-means over a table of vectors.

The table is written once, partitioned into slices by a hash of the id.  A step
reads one slice only, in which tasks assign each vector to its nearest centre
and add up vectors per centre; the few sums are fetched and each centre moves by
its share of all vectors it has seen.  Several starts advance in the same pass.
Whole passes come at the end: they choose among the starts, then move all
centres to the means of their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import write_stage

#: Rows of a slice, as far as there are at most so many slices (each is a folder),
#: and rows, by hash order, from which the first centres are drawn.
SLICE_ROWS, SLICES, INIT_ROWS = 1024, 256, 3000
#: Steps without gain after which the mini-batches end, whole passes after them, and the gain that counts.
PATIENCE, POLISH, GAIN = 8, 10, 1e-4
#: Numbers of one block of distances.
CELLS = 4_000_000


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of ``width`` numbers each as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row; the first of equals."""
    d = (centres ** 2).sum(1)[None, :] - 2 * x @ centres.T
    best = d.argmin(1)
    return best, np.maximum(d[np.arange(len(x)), best] + (x ** 2).sum(1), 0.0)


def _first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each next centre drawn with odds of its squared distance."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        p = d / d.sum() if d.sum() > 0 else None
        centres.append(x[rng.choice(len(x), p=p)])
        d = np.minimum(d, ((x - centres[-1]) ** 2).sum(1))
    return np.array(centres)


def _sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, sums, squared distance) per start and centre: one job whose
    result has starts x k rows."""
    starts, k, width = centres.shape
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        table = np.zeros((starts * k, width + 2))
        for batch in batches:
            step = max(1, CELLS // (k + width))
            for at in range(0, batch.num_rows, step):
                x = matrix(batch.column("vec").slice(at, step), width)
                for s in range(starts):
                    best, d = nearest(x, c[s])
                    own = s * k + best
                    np.add.at(table[:, 0], own, 1.0)
                    np.add.at(table[:, 1], own, d)
                    np.add.at(table[:, 2:], own, x)
        held = np.flatnonzero(table[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(held), *[pa.array(table[held, j]) for j in range(width + 2)]],
                                         ["c", *[f"v{j}" for j in range(width + 2)]])

    names = [f"v{j}" for j in range(width + 2)]
    got = rows.select("vec").mapInArrow(add, "c long, " + ", ".join(f"{n} double" for n in names)).groupBy("c").agg(
        *[F.sum(n).alias(n) for n in names]).toPandas()
    shared.unpersist()
    table = np.zeros((starts * k, width + 2))
    table[got["c"].to_numpy(int)] = got[names].to_numpy()
    table = table.reshape(starts, k, width + 2)
    return table[:, :, 0], table[:, :, 2:], table[:, :, 1]


def minibatch_centres(df: DataFrame, id_col: str, vec_col: str, width: int, k: int, seeds: tuple[int, ...] = (42, 43, 44),
                      max_steps: int = 100, slices: int | None = None) -> tuple[np.ndarray, float]:
    """(centres, cost): up to ``k`` centres of the vectors of ``width`` numbers
    and the sum of squared distances to them.  Vectors must be whole (no nulls,
    right width); fewer than ``k`` vectors give as many centres, none give none."""
    spark = df.sparkSession
    slices = slices or min(SLICES, df.count() // SLICE_ROWS + 1)
    vec = df.select(F.xxhash64(id_col).alias("h"), F.col(vec_col).cast("array<double>").alias("vec"))
    path = write_stage(vec.withColumn("slice", F.pmod("h", F.lit(slices)).cast("int")), "slices", ["slice"])
    every = spark.read.schema("h long, vec array<double>, slice int").parquet(path)
    some = every.orderBy("h", "vec").limit(INIT_ROWS).select("vec").toArrow()["vec"].combine_chunks()  # bounded
    if not len(some):
        return np.zeros((0, width)), 0.0
    x = matrix(some, width)
    k = min(k, len(x))
    centres = np.array([_first_centres(x, k, np.random.default_rng(s)) for s in seeds])
    seen = np.zeros(centres.shape[:2])
    smooth, best, waited = None, np.inf, 0
    order = np.random.default_rng(seeds[0]).permutation(slices)
    for step in range(max_steps):
        n, sums, cost = _sums(every.where(F.col("slice") == int(order[step % slices])), centres)
        if not n.any():
            continue  # an empty slice
        seen += n
        centres += np.where(n[:, :, None] > 0, (sums - n[:, :, None] * centres) / np.maximum(seen, 1)[:, :, None], 0.0)
        now = cost.sum(1).min() / n[0].sum()
        smooth = now if smooth is None else 0.7 * smooth + 0.3 * now
        waited = 0 if smooth < best * (1 - GAIN) else waited + 1
        best = min(best, smooth)
        if waited >= PATIENCE:
            break
    n, sums, cost = _sums(every, centres)
    totals = cost.sum(1)
    at = int((totals <= totals.min() * (1 + 1e-9)).argmax())  # the first of equals, whatever the order of the sums
    one, total = centres[at:at + 1], float(cost[at].sum())
    n, sums = n[at:at + 1], sums[at:at + 1]
    for _ in range(POLISH):
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], one)
        n, sums, cost = _sums(every, moved)
        gain, before = total - float(cost.sum()), total
        if gain <= 0:
            break
        one, total = moved, float(cost.sum())
        if gain < GAIN * before:
            break
    return one[0], total


def assign(df: DataFrame, vec_col: str, centres: np.ndarray, out: str = "cluster") -> DataFrame:
    """``df`` with the number of each vector's nearest centre (the first of
    equals); vectors must be whole, and there must be a centre."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    @F.arrow_udf("int")
    def label(v: pa.Array) -> pa.Array:
        c = shared.value
        step = max(1, CELLS // sum(c.shape))
        parts = [nearest(matrix(v.slice(a, step), c.shape[1]), c)[0] for a in range(0, len(v), step)]
        return pa.array(np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32))
    return df.withColumn(out, label(F.col(vec_col).cast("array<double>")))

"""Structured Streaming jobs: filtered ingest, prefix dedup, per-group quota
and micro-batch upsert.

Every job writes through a checkpointed query, so a restart resumes from
the last committed offsets; ``foreachBatch`` sinks write one partition per
batch id with dynamic partition overwrite, so a replayed batch rewrites its
own output instead of duplicating it.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.operators import dedup
from tessera.operators import filters as fl
from tessera.session import checkpoint_dir, path_exists, stage_table, write_stage



def fresh_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    """A new (sink, checkpoint) pair under the shared checkpoint folder."""
    base = os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:10]}")
    return base + "/sink", base + "/checkpoint"


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files landing in ``path`` as an unbounded table."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def run_available_now(stream: DataFrame, sink: str, ckpt: str, partition_by: list[str] | None = None,
                      output_mode: str = "append") -> str:
    """Process everything available now into a Parquet sink, then stop."""
    w = (stream.writeStream.format("parquet").option("path", sink)
               .option("checkpointLocation", ckpt).outputMode(output_mode)
               .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()
    return sink


def ingest_relevant(stream: DataFrame, text: str = "text", date: str = "date",
                    source: str = "sitename", **params) -> DataFrame:
    """Incremental filtered ingest: the batch relevance predicate on a stream."""
    return stream.where(fl.relevance(F.col(text), F.col(date), F.col(source), **params))


def _first_of_batch(keys: list[str]):
    """mapInArrow body: the first row per key of each Arrow batch, stateless."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows), pa.int64()))
            first = table.group_by(keys).aggregate([("_row", "min")])["_row_min"]
            yield batch.take(first.combine_chunks())
    return run


def dedup_prefix_stream(stream: DataFrame, text: str, group: str, event_time: str,
                        delay: str = "366 days", prefix_len: int = 50) -> DataFrame:
    """Drop rows whose (group, text prefix) was already seen.

    Copies are dropped within each Arrow batch first, so a prefix that many
    rows share sends one row per batch to the task that keeps its state.
    State per key is kept until the watermark passes the first occurrence
    plus ``delay``; with ``group`` a calendar year and a delay above one
    year every duplicate that arrives before the watermark moves past its
    year is dropped.
    """
    keyed = stream.withColumn("prefix", F.substring(F.col(text), 1, prefix_len))
    once = keyed.mapInArrow(_first_of_batch([group, "prefix"]), keyed.schema)
    return once.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([group, "prefix"])


def _landed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The batch written as it came and read back by the caller's session.  A
    stream's own session plans without adaptive execution, so every step of even
    a small batch would run all shuffle partitions."""
    return spark.read.schema(df.schema).parquet(write_stage(df, "batch"))


def _write_part(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None, below: list[str] | None = None) -> None:
    """Write one batch's partitions of a table (``below``: within the batch); a
    replay overwrites them."""
    (df.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(*(partition_by or []), "batch", *(below or [])).parquet(path))


def _earlier(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
    """Rows that batches before ``batch_id`` wrote; None before the first one.
    Only an absent path counts as that: any other error fails the batch."""
    if not path_exists(spark, path):
        return None
    known = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(known).parquet(path).where(F.col("batch") < batch_id)


#: Parts of the key table by hash; blocks of 512 bits of a Bloom filter, and bits set per key.
KEY_PARTS, FILTER_BLOCKS, FILTER_BITS = 16, 4096, 6
_WORDS = [f"_w{i}" for i in range(8)]


def _bits(keys: list[str], blocks: int) -> list[Column]:
    """A key's block, and its bits there as eight 64-bit words."""
    block = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(blocks)).cast("int").alias("_block")
    chosen = F.xxhash64(F.lit(1), *[F.col(k) for k in keys])
    places = [F.shiftrightunsigned(chosen, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(FILTER_BITS)]
    one = F.lit(1).cast("long")
    words = []
    for w, name in enumerate(_WORDS):
        bits = [F.when(F.shiftright(p, 6) == w, F.call_function("shiftleft", one, p.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for p in places]
        words.append(reduce(Column.bitwiseOR, bits).alias(name))
    return [block, *words]


def _candidates(seen: DataFrame, doubtful: DataFrame, wanted: list[int], prune_col: str | None) -> DataFrame:
    """The kept keys that lie where doubtful rows do; other parts are skipped."""
    near = seen.where(F.col("_part").isin(wanted))
    return near.join(doubtful.select(prune_col).distinct(), prune_col, "left_semi") if prune_col else near


def dedup_stream_exact(stream: DataFrame, sink: str, ckpt: str, keys: list[str], order: list[str],
                       prune_col: str | None = None, filter_blocks: int = FILTER_BLOCKS) -> str:
    """Keep the first row per key across micro-batches, exactly and without
    a watermark.

    Each batch first collapses its own copies with ``keep_first`` (an
    aggregation, so a group of copies is pre-combined in every task before
    the shuffle).  A Bloom filter per value of ``prune_col`` (one of the keys,
    e.g. the year) tells which of them earlier batches cannot have kept: those
    are new.  The others are checked against the key table ``sink/_keys`` with a
    left anti join; it is parted by ``prune_col`` and a hash of the keys, and
    only parts in which such a row lies are read, so a batch reads few keys
    however many there are.  The filter is ``filter_blocks`` rows of 512 bits
    for each value of ``prune_col`` (about ten bits a key are wanted: 4096
    blocks for 200,000 keys); a full one costs reads, not correctness.  Output
    rows go to ``sink/batch=<id>``; a replayed batch compares against earlier
    batches only and overwrites its own partitions.
    """
    spark = stream.sparkSession
    if prune_col is not None and prune_col not in keys:
        raise ValueError("prune_col must be one of the keys")
    key_root, filter_root = f"{sink}/_keys", f"{sink}/_filter"
    parts = [prune_col] if prune_col else []
    key_schema = T.StructType([*[stream.schema[k] for k in keys if k not in parts], *[stream.schema[k] for k in parts],
                               T.StructField("_part", T.IntegerType())])
    filter_schema = T.StructType([*[stream.schema[k] for k in parts], T.StructField("_block", T.IntegerType()),
                                  *[T.StructField(w, T.LongType()) for w in _WORDS]])
    part = F.pmod(F.xxhash64(F.lit(2), *[F.col(k) for k in keys]), F.lit(KEY_PARTS)).cast("int")

    def per_batch(df: DataFrame, batch_id: int) -> None:
        first = dedup.keep_first(_landed(spark, df), keys, order)
        # Only the last batch's filter is wanted: the others' folders are not listed.
        last = f"{filter_root}/batch={batch_id - 1}"
        known = spark.read.schema(filter_schema).parquet(last) if path_exists(spark, last) else None
        fresh = first
        if known is not None:
            coded = first.select("*", *_bits(keys, filter_blocks))
            same = F.col("_block") == F.col("_b")
            for i, k in enumerate(parts):
                same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
            held = known.select(F.col("_block").alias("_b"), *[F.col(k).alias(f"_g{i}") for i, k in enumerate(parts)],
                                *[F.col(w).alias(f"f{w}") for w in _WORDS])
            maybe = F.lit(True)
            for w in _WORDS:
                maybe = maybe & (F.coalesce(F.col(f"f{w}"), F.lit(0)).bitwiseAND(F.col(w)) == F.col(w))
            # Staged, not cached: a cached plan keeps all its shuffle partitions.
            told = stage_table(coded.join(held, same, "left").select(*first.columns, maybe.alias("_maybe"), part.alias("_part")), "told")
            doubtful = told.where("_maybe")
            wanted = [r["_part"] for r in doubtful.select("_part").distinct().collect()]  # at most KEY_PARTS
            fresh = told.where("NOT _maybe").select(*first.columns)
            seen = _earlier(spark, key_root, key_schema, batch_id) if wanted else None
            if seen is not None:
                seen = _candidates(seen, doubtful, wanted, prune_col)
                same = F.lit(True)
                old = seen.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
                for i, k in enumerate(keys):
                    same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
                fresh = fresh.unionByName(doubtful.select(*first.columns).join(old, same, "left_anti"))
        fresh.hint("rebalance").write.mode("overwrite").parquet(_batch_part(sink, batch_id))
        fresh = spark.read.schema(first.schema).parquet(_batch_part(sink, batch_id))
        # One task writes a folder, so a batch adds one file to it however many tasks there are.
        _write_part(fresh.select(*keys, part.alias("_part")).repartition(*parts, "_part"), key_root, batch_id, parts, ["_part"])
        made = fresh.select(*parts, *_bits(keys, filter_blocks))
        merged = made if known is None else made.unionByName(known)
        merged = merged.groupBy(*parts, "_block").agg(*[F.bit_or(w).alias(w) for w in _WORDS])
        _write_part(merged.hint("rebalance"), filter_root, batch_id)

    (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
           .trigger(availableNow=True).start().awaitTermination())
    return sink


def _batch_part(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def quota_stream(stream: DataFrame, sink: str, ckpt: str, group: str, order: list[str],
                 quota: int) -> str:
    """Keep the first ``quota`` rows per group across micro-batches.

    The state is how many rows per group each batch kept, a small table under
    ``sink/_kept``; kept rows are never read again.  A batch ranks its own rows
    per group (``row_number <= quota`` lets WindowGroupLimit cut every task to
    ``quota`` rows per group before the shuffle), writes what earlier batches
    leave room for to ``sink/batch=<id>``, and then its counts.  A replayed
    batch counts earlier batches only and overwrites both.
    """
    spark = stream.sparkSession
    kept_root = f"{sink}/_kept"
    kept_schema = T.StructType([T.StructField("_group", stream.schema[group].dataType), T.StructField("_n", T.LongType())])

    def per_batch(df: DataFrame, batch_id: int) -> None:
        w = Window.partitionBy(group).orderBy(*[F.col(c) for c in order])
        ranked = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= quota)
        prev = _earlier(spark, kept_root, kept_schema, batch_id)
        if prev is not None:
            kept = prev.groupBy("_group").agg(F.sum("_n").alias("_kept"))
            ranked = ranked.join(kept, F.col(group).eqNullSafe(F.col("_group")), "left")
            ranked = ranked.where(F.col("_rn") <= F.lit(quota) - F.coalesce("_kept", F.lit(0)))
        part = _batch_part(sink, batch_id)
        ranked.select(*df.columns).write.mode("overwrite").parquet(part)
        counts = spark.read.schema(df.schema).parquet(part).groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
        _write_part(counts, kept_root, batch_id)

    (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
           .trigger(availableNow=True).start().awaitTermination())
    return sink


def upsert_stream(stream: DataFrame, initial: DataFrame, table_root: str, ckpt: str,
                  keys: list[str], order_col: str, compact_every: int = 20) -> str:
    """Micro-batch upsert: per key the row with the largest ``order_col``, of
    equals the one that came last.

    Each batch writes its own newest row per key to ``changes/batch=<id>``, so
    a batch costs what it holds; every ``compact_every`` batches the table is
    merged into ``base/upto=<id>``.  A read merges the newest complete base with
    the changes after it.  A replayed batch overwrites its own folders; a failed
    read fails the batch and leaves the table as it was.
    """
    spark = stream.sparkSession
    cols = initial.columns
    if order_col not in cols:
        raise ValueError(f"initial rows need the order column {order_col!r}")
    if not path_exists(spark, f"{_base(table_root, -1)}/_SUCCESS"):
        dedup.keep_last(initial, keys, [order_col]).select(*cols).write.mode("overwrite").parquet(_base(table_root, -1))

    def per_batch(df: DataFrame, batch_id: int) -> None:
        newest = dedup.keep_last(df.select(*cols), keys, [order_col]).select(*cols)
        _write_part(newest, _changes(table_root), batch_id)
        if (batch_id + 1) % compact_every == 0:
            read_upserts(spark, table_root, keys, order_col, batch_id).write.mode("overwrite").parquet(_base(table_root, batch_id))

    (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
           .trigger(availableNow=True).start().awaitTermination())
    return table_root


def _base(table_root: str, batch_id: int) -> str:
    return f"{table_root}/base/upto={batch_id}"


def _changes(table_root: str) -> str:
    return f"{table_root}/changes"


def read_upserts(spark: SparkSession, table_root: str, keys: list[str], order_col: str, upto: int | None = None) -> DataFrame:
    """The table after batch ``upto`` (by default the last one)."""
    schema = spark.read.parquet(_base(table_root, -1)).schema
    known = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    found = [r["upto"] for r in spark.read.parquet(f"{table_root}/base").select("upto").distinct().collect()]  # one per compaction
    # A base whose write was cut off has no success marker.
    start = max(b for b in found if (upto is None or b < upto) and path_exists(spark, f"{_base(table_root, b)}/_SUCCESS"))
    rows = spark.read.schema(schema).parquet(_base(table_root, start)).withColumn("batch", F.lit(start).cast("long"))
    if path_exists(spark, _changes(table_root)):
        after = spark.read.schema(known).parquet(_changes(table_root)).where(F.col("batch") > start)
        rows = rows.unionByName(after if upto is None else after.where(F.col("batch") <= upto))
    return dedup.keep_last(rows, keys, [order_col, "batch"]).select(*schema.names)

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import dedup
from tessera.plans import q_stream
from tessera.session import checkpoint_dir
from tessera.streaming import ingest as st

SCHEMA = "id long, year int, ts timestamp, text string, o int"


def _land(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def test_restart_is_exactly_once(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    _land(spark, src, [(1, 2021, dt.datetime(2021, 1, 1), "a", 1)])
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    schema = spark.read.parquet(src).schema
    st.run_available_now(st.file_stream(spark, src, schema), sink, ck)
    st.run_available_now(st.file_stream(spark, src, schema), sink, ck)  # nothing new
    assert spark.read.parquet(sink).count() == 1
    _land(spark, src, [(2, 2021, dt.datetime(2021, 1, 2), "b", 2)])
    st.run_available_now(st.file_stream(spark, src, schema), sink, ck)  # only the new file
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_stream_dedup_equals_batch(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    p = "p" * 50
    rows = [(1, 2021, dt.datetime(2021, 3, 1), p + "x", 1), (2, 2021, dt.datetime(2021, 4, 1), p + "y", 2),
            (3, 2022, dt.datetime(2022, 3, 1), p + "z", 3), (4, 2022, dt.datetime(2022, 5, 1), "q", 4)]
    _land(spark, src, rows[:2])
    _land(spark, src, rows[2:])
    schema = spark.read.parquet(src).schema
    s = st.dedup_prefix_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), "text", "year", "ts")
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    st.run_available_now(s.select("year", "prefix"), sink, ck)
    got = sorted((r.year, r.prefix) for r in spark.read.parquet(sink).collect())
    assert got == [(2021, p), (2022, p), (2022, "q")]


def test_quota_across_batches(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    _land(spark, src, [(i, 2021, dt.datetime(2021, 1, 1), "t", i) for i in range(3)])
    _land(spark, src, [(i, 2021, dt.datetime(2021, 1, 1), "t", i) for i in range(3, 6)]
          + [(9, 2022, dt.datetime(2022, 1, 1), "t", 9)])
    schema = spark.read.parquet(src).schema
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    st.quota_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ck, "year", ["o"], 4)
    got = sorted((r.year, r.id) for r in spark.read.parquet(sink).collect())
    assert got == [(2021, 0), (2021, 1), (2021, 2), (2021, 3), (2022, 9)]


def test_upsert_stream_matches_batch_upsert(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    initial = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, title string, v int")
    for wave in ([(2, "b1", 1), (3, "c1", 1)], [(2, "b2", 2)], [(3, "c0", 0)]):
        spark.createDataFrame(wave, "id long, title string, v int").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    root, ck = os.path.join(tmpdir_fresh, "tbl"), os.path.join(tmpdir_fresh, "ck")
    st.upsert_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), initial, root, ck, ["id"], "v")
    got = sorted(tuple(r) for r in st.read_upserts(spark, root, ["id"], "v").collect())
    batch = dedup.upsert_latest(initial, spark.read.parquet(src), ["id"], "v")
    # streaming keeps the largest version per key; (3, 'c0', 0) is older than c1
    assert got == [(1, "a", 0), (2, "b2", 2), (3, "c1", 1)]
    assert F is not None and batch.count() == 3


def test_upsert_writes_only_changes_until_it_compacts(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    initial = spark.createDataFrame([(i, f"t{i}", 0) for i in range(200)], "id long, title string, v int")
    for wave in range(5):
        spark.createDataFrame([(5, f"new{wave}", wave + 1), (300 + wave, "x", 0)], "id long, title string, v int").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    root, ck = os.path.join(tmpdir_fresh, "tbl"), os.path.join(tmpdir_fresh, "ck")
    st.upsert_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), initial, root, ck, ["id"], "v", compact_every=3)
    assert spark.read.parquet(f"{root}/changes").count() == 10  # two rows a batch
    assert sorted(os.listdir(f"{root}/base")) == ["upto=-1", "upto=2"] and spark.read.parquet(f"{root}/base/upto=2").count() == 203
    latest = {r.id: r.title for r in st.read_upserts(spark, root, ["id"], "v").collect()}
    assert len(latest) == 205 and latest[5] == "new4" and latest[6] == "t6"
    os.remove(f"{root}/base/upto=2/_SUCCESS")  # a compaction that was cut off does not count
    assert {r.id: r.title for r in st.read_upserts(spark, root, ["id"], "v").collect()} == latest


def test_upsert_replayed_batch_is_idempotent(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    initial = spark.createDataFrame([(i, f"t{i}", 0) for i in range(50)], "id long, title string, v int")
    for wave in ([(1, "a", 1), (60, "b", 1)], [(1, "c", 2)]):
        spark.createDataFrame(wave, "id long, title string, v int").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    root, ck = os.path.join(tmpdir_fresh, "tbl"), os.path.join(tmpdir_fresh, "ck")
    st.upsert_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), initial, root, ck, ["id"], "v", compact_every=2)
    before = sorted(tuple(r) for r in st.read_upserts(spark, root, ["id"], "v").collect())
    # Simulate a crash after the last batch wrote its output but before it committed.
    commits = sorted(int(f) for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit())
    os.remove(os.path.join(ck, "commits", str(commits[-1])))
    crc = os.path.join(ck, "commits", f".{commits[-1]}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    st.upsert_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), initial, root, ck, ["id"], "v", compact_every=2)
    after = sorted(tuple(r) for r in st.read_upserts(spark, root, ["id"], "v").collect())
    assert after == before and len(after) == 51
    assert dict((r[0], r[1]) for r in after)[1] == "c"


def test_exact_dedup_across_batches(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    hot = [(i, 2021, dt.datetime(2021, 1, 1), "same", i) for i in range(500)]  # one key, many copies
    _land(spark, src, hot[:250] + [(900, 2022, dt.datetime(2022, 1, 1), "other", 0)])
    _land(spark, src, hot[250:] + [(901, 2022, dt.datetime(2022, 1, 2), "other", 0),
                                   (902, 2023, dt.datetime(2023, 1, 1), "new", 0)])
    schema = spark.read.parquet(src).schema
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    s = st.file_stream(spark, src, schema, max_files_per_trigger=1)
    st.dedup_stream_exact(s, sink, ck, ["year", "text"], ["ts", "id"], prune_col="year")
    got = sorted((r.year, r.text, r.id) for r in spark.read.parquet(sink).collect())
    # first batch wins for keys seen in both; within a batch the first by (ts, id)
    assert got == [(2021, "same", 0), (2022, "other", 900), (2023, "new", 902)]


def test_failed_read_fails_the_batch_and_keeps_the_table(spark, tmpdir_fresh):
    src, root, ck = (os.path.join(tmpdir_fresh, x) for x in ("src", "tbl", "ck"))
    initial = spark.createDataFrame([(i, f"t{i}", 0) for i in range(50)], "id long, title string, v int")

    def wave(row):
        spark.createDataFrame([row], "id long, title string, v int").coalesce(1).write.mode("append").parquet(src)
        st.upsert_stream(st.file_stream(spark, src, spark.read.parquet(src).schema), initial, root, ck, ["id"], "v", compact_every=2)
    wave((1, "a", 1))
    before = sorted(tuple(r) for r in st.read_upserts(spark, root, ["id"], "v").collect())
    assert len(before) == 50
    bad = os.path.join(root, "changes", "batch=0", "part-bad.parquet")
    with open(bad, "wb") as f:
        f.write(b"not parquet")
    with pytest.raises(Exception):
        wave((2, "b", 2))  # this batch compacts, so it reads
    os.remove(bad)
    got = sorted(tuple(r) for r in st.read_upserts(spark, root, ["id"], "v", 0).collect())
    assert got == before


def test_failed_read_fails_dedup_and_quota(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    _land(spark, src, [(1, 2021, dt.datetime(2021, 1, 1), "a", 1)])
    schema = spark.read.parquet(src).schema
    runs = {"dedup": lambda sink, ck: st.dedup_stream_exact(st.file_stream(spark, src, schema), sink, ck, ["year", "text"],
                                                            ["id"], prune_col="year"),
            "quota": lambda sink, ck: st.quota_stream(st.file_stream(spark, src, schema), sink, ck, "year", ["id"], 1)}
    sinks = {k: (os.path.join(tmpdir_fresh, k), os.path.join(tmpdir_fresh, k + "-ck")) for k in runs}
    for k, run in runs.items():
        run(*sinks[k])
    _land(spark, src, [(2, 2021, dt.datetime(2021, 1, 2), "a", 2)])
    for k, run in runs.items():
        folder = os.path.join(sinks[k][0], "_keys", "year=2021", "batch=0") if k == "dedup" else os.path.join(sinks[k][0], "_kept", "batch=0")
        with open(os.path.join(folder, "part-bad.parquet"), "wb") as f:
            f.write(b"not parquet")
        with pytest.raises(Exception):
            run(*sinks[k])


def test_filter_spares_reading_keys(spark, tmpdir_fresh, monkeypatch):
    """Over twenty batches few of the keys kept are read again, and the result
    is exact; a filter far too small changes only what is read."""
    src = os.path.join(tmpdir_fresh, "src")
    rows = []
    for b in range(20):
        wave = [(b * 200 + i, 2021 + i % 2, dt.datetime(2021, 1, 1 + b), f"key {b} {i}", i) for i in range(100)]
        wave += [(b * 200 + 150, 2021, dt.datetime(2021, 1, 1 + b), f"key {b - 1} 0", 0)]  # seen before
        rows += wave
        _land(spark, src, wave)
    schema = spark.read.parquet(src).schema
    want = {(r[1], r[3]) for r in rows}
    candidates, reads = st._candidates, []

    def watched(*args):
        found = candidates(*args)
        reads.append(found.count())
        return found
    monkeypatch.setattr(st, "_candidates", watched)
    for name, blocks, files, spared in (("wide", 4096, 1, True), ("tiny", 1, 7, False)):
        reads.clear()
        sink, ck = os.path.join(tmpdir_fresh, name), os.path.join(tmpdir_fresh, name + "-ck")
        st.dedup_stream_exact(st.file_stream(spark, src, schema, max_files_per_trigger=files), sink, ck, ["year", "text"], ["ts", "id"],
                              prune_col="year", filter_blocks=blocks)
        kept = [(r.year, r.text) for r in spark.read.parquet(sink).collect()]
        assert len(kept) == len(set(kept)) and set(kept) == want
        told = spark.read.parquet(f"{sink}/_filter").where(f"batch = {20 // files - (files == 1)}")
        assert told.count() <= 2 * blocks
        if spared:  # one doubtful key a batch: one part of sixteen, of one of two years
            assert len(reads) == 19 and max(reads) < 0.15 * len(want)


def test_quota_with_a_hot_year_over_many_batches(spark, tmpdir_fresh):
    """Batches after the quota is full keep nothing, and read counts only."""
    src = os.path.join(tmpdir_fresh, "src")
    for b in range(6):
        _land(spark, src, [(b * 100 + i, 2021 if i % 3 else None, dt.datetime(2021, 1, 1 + b), "t", i) for i in range(60)])
    schema = spark.read.parquet(src).schema
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    st.quota_stream(st.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ck, "year", ["ts", "id"], 70)
    kept = spark.read.parquet(sink)
    assert {r.year: r["count"] for r in kept.groupBy("year").count().collect()} == {2021: 70, None: 70}
    assert spark.read.parquet(f"{sink}/_kept").count() <= 12


def test_null_keys_are_one_key(spark, tmpdir_fresh):
    src = os.path.join(tmpdir_fresh, "src")
    _land(spark, src, [(1, 2021, dt.datetime(2021, 1, 1), None, 1)])
    _land(spark, src, [(2, 2021, dt.datetime(2021, 1, 2), None, 2)])
    schema = spark.read.parquet(src).schema
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    st.dedup_stream_exact(st.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ck, ["year", "text"], ["id"])
    assert spark.read.parquet(sink).count() == 1


def test_dedup_batches_write_few_files(spark, tmpdir_fresh):
    """A batch adds one file to each folder of the key table and few files
    elsewhere, whatever the number of shuffle partitions (cluster default 200)."""
    src = os.path.join(tmpdir_fresh, "src")
    for b in range(2):
        _land(spark, src, [(b * 1000 + i, 2021, dt.datetime(2021, 1, 1), f"key {b * 500 + i}", i) for i in range(1000)])
    schema = spark.read.parquet(src).schema
    sink, ck = os.path.join(tmpdir_fresh, "sink"), os.path.join(tmpdir_fresh, "ck")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        st.dedup_stream_exact(st.file_stream(spark, src, schema, max_files_per_trigger=1), sink, ck, ["year", "text"], ["ts", "id"], prune_col="year")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert spark.read.parquet(sink).count() == 1500
    files = {}
    for folder, _, names in os.walk(sink):
        files[folder] = sum(n.endswith(".parquet") for n in names)
    keys = [n for f, n in files.items() if "_part=" in f]
    assert len(keys) > 16 and max(keys) == 1
    assert max(n for f, n in files.items() if "_keys" not in f) <= 4


def _documents(spark, folder, n, files):
    rows = [(i, f"title {i}\nbody {i % 40}", "de" if i % 3 else "en", "blog", 1900 + i % 200) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(
        os.path.join(folder, "documents.parquet"))


def _landed_files(spark, name):
    root = checkpoint_dir(spark).replace("file:", "")
    newest = max((os.path.join(root, "tables", d) for d in os.listdir(os.path.join(root, "tables")) if d.startswith(name)), key=os.path.getmtime)
    return [os.path.join(f, n) for f, _, names in os.walk(newest) for n in names if n.endswith(".parquet")]


def test_sources_land_in_files_by_size_not_by_tasks(spark, tmpdir_fresh):
    _documents(spark, tmpdir_fresh, 300, 12)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))  # few files to a task
    try:
        q_stream._source(spark, tmpdir_fresh)
        assert 1 <= len(_landed_files(spark, "news_source")) <= 12  # six years; tasks x years before
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)


def test_upsert_waves_are_written_by_many_tasks(spark, tmpdir_fresh):
    """No task reads all posts to land a wave, and each wave is a micro-batch."""
    _documents(spark, tmpdir_fresh, 300, 12)
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    try:
        rows = {r.id: (r.title, r.version) for r in q_stream.q_stream_upsert(spark, tmpdir_fresh).collect()}
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", was)
    assert len(_landed_files(spark, "upsert_updates")) > 9  # three before
    for i in range(300):
        version = 2 if i % 3 else 3 if 1900 + i % 200 > 2000 else 1
        assert rows[i] == (f"title {i} v{version}", version)
    assert len(rows) == 300

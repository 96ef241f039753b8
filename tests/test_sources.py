import json
import os
import uuid

from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.schemas import NEWS_CSV
from tessera.sources import readers, sinks


def _page(nodes):
    return json.dumps({"data": {"tag": {"posts": {"pageInfo": {"hasNextPage": False, "endCursor": None},
                                                  "edges": [{"node": n} for n in nodes]}}}})


def test_flatten_pages_fallbacks(spark, tmpdir_fresh):
    nodes = [
        {"id": "1", "title": "T1", "url": "http://a", "slug": "s1", "publishedAt": "2024-01-01",
         "content": {"markdown": "hi `x` [l](u)"}, "tags": [{"name": "AI", "slug": "ai"}, {"name": "ML", "slug": "ml"}]},
        {"id": "2", "title": "T2", "slug": "s2", "tags": []},  # no url, no content
    ]
    path = os.path.join(tmpdir_fresh, "pages.jsonl")
    with open(path, "w") as f:
        f.write(_page(nodes) + "\n")
        f.write("{not json\n")  # malformed line yields no rows
    pages = spark.read.text(path)
    got = {r.id: r for r in readers.flatten_pages(pages).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].tags == '["ai","ml"]' and got["1"].body_text == "hi l"
    assert got["2"].url == "https://hashnode.com/post/s2" and got["2"].body_text == "" and got["2"].tags == "[]"


def test_csv_roundtrip_multiline(spark, tmpdir_fresh):
    rows = [("http://u", "2021-02-03", "t", 'body, with "quotes"\nand newline', "CNN")]
    df = spark.createDataFrame(rows, NEWS_CSV)
    out = os.path.join(tmpdir_fresh, "csv", "2021")
    sinks.write_csv(df, out)
    back = readers.read_csv_dir(spark, os.path.join(tmpdir_fresh, "csv"), rename={"sitename": "source"})
    assert back.columns[-1] == "source"
    assert [tuple(r) for r in back.collect()] == rows


def test_year_partition_pruning(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, 2021), (2, 2022), (3, 2023)], "id long, year int")
    root = os.path.join(tmpdir_fresh, "by_year")
    sinks.write_table(df, root, partition_by=["year"])
    r = readers.read_year_partitions(spark, root, [2022])
    assert [x.id for x in r.collect()] == [2]
    assert "PartitionFilters: [isnotnull(year" in r._jdf.queryExecution().executedPlan().toString()


def test_truncate_and_load_keeps_schema(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "t")
    sinks.write_table(spark.createDataFrame([(1, "a")], "id long, name string"), path)
    new = spark.createDataFrame([("b", 2, "extra")], "name string, id int, more string")
    sinks.truncate_and_load(spark, new, path)
    back = spark.read.parquet(path)
    assert back.dtypes == [("id", "bigint"), ("name", "string")]
    assert [tuple(r) for r in back.collect()] == [(2, "b")]
    assert sinks.row_count(spark, path) == 1


def test_append_all(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "u")
    a = spark.createDataFrame([(1,)], "id long")
    b = spark.createDataFrame([(2, "x")], "id long, s string")
    sinks.append_all([a, b], path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]


def test_read_table_allow_list(spark):
    import pytest
    with pytest.raises(ValueError):
        readers.read_table(spark, "x; drop", ["articles"])


def test_staged_posts_view_row_count(spark):
    from tessera.sources.tables import posts
    p = posts(spark, "/root/testdata/sf0.001")
    assert p.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert p.where(F.col("pos_score").isNull()).count() > 0


def test_side_csv_inferred(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "side.csv")
    with open(path, "w") as f:
        f.write("company,laid_off,date\nacme,10,2023-01-02\nbeta,,2023-02-03\n")
    df = readers.read_side_csv(spark, path)
    assert dict(df.dtypes)["laid_off"] == "int" and df.count() == 2


def test_store_vectors_and_multi_table_run(spark, tmpdir_fresh):
    from tessera.operators import batch, models
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, text string")

    def job(name):
        if name == "missing":
            raise ValueError("no such table")
        out = os.path.join(tmpdir_fresh, name)
        sinks.write_table(models.embed_batches(docs, "text", models.hashing_encoder(8), 8), out)
        return sinks.row_count(spark, out)

    r = {x.table: (x.ok, x.rows, x.error) for x in batch.run_for_tables(spark, ["posts", "missing"], job).collect()}
    assert r["posts"] == (True, 2, None)
    assert r["missing"][0] is False and "no such table" in r["missing"][2]
    stored = spark.read.parquet(os.path.join(tmpdir_fresh, "posts"))
    assert dict(stored.dtypes)["embedding"] == "array<float>"


def test_write_counted_matches_reread(spark, tmpdir_fresh):
    df = spark.range(1234).withColumn("y", F.col("id") % 3)
    path = os.path.join(tmpdir_fresh, "counted")
    assert sinks.write_table_counted(df, path, partition_by=["y"]) == 1234 == sinks.row_count(spark, path)


def _cursor_page(end, more):
    info = {"hasNextPage": more, "endCursor": end}
    return json.dumps({"data": {"tag": {"posts": {"pageInfo": info, "edges": []}}}})


def test_cursor_chains(spark):
    """Each chain has one fault; positions count from the first page."""
    chains = {
        "sound": [(None, "a", True), ("a", "b", True), ("b", "c", False)],
        "unread": [(None, "a", True), ("a", "b", True)],
        "gap": [(None, "a", True), ("a", "b", False), ("x", "y", False)],
        "loop": [(None, "a", True), ("a", "b", True), ("b", "a", True)],
        "circle": [("a", "b", True), ("b", "a", True)],
        "none": [(None, None, True)],
        "twice": [(None, "a", True), (None, "a", True), ("a", "z", False)],
        "long": [(f"p{i}" if i else None, f"p{i + 1}", i < 299) for i in range(300)],
    }
    rows = [(t, a, _cursor_page(e, m)) for t, ps in chains.items() for a, e, m in ps] + [("bad", None, "{broken"), (None, None, _cursor_page("q", False)), ("blank", None, None)]
    df = spark.createDataFrame(rows, "tag string, after string, value string").repartition(3)
    got = {(r.tag, r.after): (r.position, r.problem) for r in readers.cursor_chains(df, ["tag"]).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "sound"} == {None: (1, None), "a": (2, None), "b": (3, None)}
    assert got["unread", "a"] == (2, "unread") and got["gap", "x"] == (None, "gap") and got["gap", "a"] == (2, None)
    assert got["loop", "b"] == (3, "loop") and got["loop", "a"] == (2, None)
    assert got["circle", "a"] == got["circle", "b"] == (None, "loop")
    assert got["none", None] == (1, "no cursor") and got["twice", None] == (1, "repeated") and got["twice", "a"] == (2, None)
    assert [got["long", f"p{i}" if i else None] for i in range(300)] == [(i + 1, None) for i in range(300)]
    assert got["bad", None] == got["blank", None] == (1, "corrupt") and got[None, None] == (1, None)
    assert readers.cursor_chains(df.limit(0), ["tag"]).count() == 0


def test_bucketed_tables_join_without_exchange(spark, tmpdir_fresh):
    a = spark.range(500).selectExpr("id", "id * 2 AS x", "0.5 AS pos", "0.1 AS neg")
    b = spark.range(0, 500, 3).selectExpr("id", "id || 't' AS title")
    ta = sinks.write_bucketed(a, f"a_{uuid.uuid4().hex}", ["id"], 4, f"{tmpdir_fresh}/a")
    tb = sinks.write_bucketed(b, f"b_{uuid.uuid4().hex}", ["id"], 4, f"{tmpdir_fresh}/b")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = joins.serving_join(ta, tb, "id", ["x", "pos", "neg"], ["title"], "pos", "neg")
        merged = ta.groupBy("id").agg(F.max("x").alias("x"))
        for df in (joined, merged):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 167 and merged.count() == 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)

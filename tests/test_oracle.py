"""Every registered query against its DuckDB twin on the smallest data.

The driver runs the same comparison at sf0.01; model fits (slow, no twin)
are exercised in test_models.py instead.
"""

import pytest

import __spark_entry__ as entry
from tessera.plans.check import _rows
from tessera.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
#: The pipeline's queries have tests of their own.
PIPELINE = set(entry._load_llm()[0])
SKIP = PIPELINE | {"lda_dominant_topic", "lda_topic_words", "kmeans_clusters", "embed_tfidf", "embed_batches"}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(rows, df.columns, 6) == _rows(cur.fetchall(), dcols, 6)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["dominant_topic", "positive", "negative"]
    assert df.count() > 0

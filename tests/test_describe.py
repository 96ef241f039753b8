"""Label scores against a plain Python version and against known languages."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import describe as ds
from tessera.operators import labels as lb
from tessera.plans.q_models import PROBE_STOP_WORDS
from tessera.plans.q_scoring import PROBE_LABELS

SF = "/root/testdata/sf0.01"


def _tokens(text):
    return re.findall(r"\b\w\w+\b", (text or "").lower())


def _brute(rows, descriptions, expand, share, min_df, max_df):
    counts = {i: Counter(_tokens(t)) for i, t in rows}
    n = len(rows)
    total, docs = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        docs.update(c.keys())
    vocab = [t for t in total if min_df <= docs[t] <= max_df * n]
    idf = {t: math.log((n + 1) / (docs[t] + 1)) for t in vocab}
    vectors = []
    for words in descriptions.values():
        seeds = {t: c for t, c in Counter(_tokens(words)).items() if t in idf}
        near = {}
        for t in idf:
            if t not in seeds and seeds:
                a = sum(sum(t in c and s in c for c in counts.values()) / math.sqrt(docs[s] * docs[t]) for s in seeds) / len(seeds)
                if a > 0:
                    near[t] = round(a, 9)
        best = sorted(near, key=lambda t: (-near[t], t))[:expand]
        w = {t: c * idf[t] for t, c in seeds.items()} | {t: share * near[t] * idf[t] for t in best}
        norm = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({t: x / norm for t, x in w.items()} if norm else {})
    out = {}
    for i, c in counts.items():
        x = {t: k * idf[t] for t, k in c.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in x.values()))
        out[i] = [sum(x[t] * v.get(t, 0.0) for t in x) / norm if norm else 0.0 for v in vectors]
    return out


def test_equals_plain_python(spark):
    rnd = random.Random(3)
    words = [f"w{k:02d}" for k in range(40)]
    rows = [(i, " ".join(rnd.choice(words[k % 4 * 10:k % 4 * 10 + 14]) for _ in range(rnd.randint(0, 25)))) for i, k in enumerate(range(120))]
    rows += [(500, None), (501, ""), (502, "unknown other")]
    labels = {"a": "w01 w02 w02 nothing", "b": "W15", "c": "absent"}
    df = spark.createDataFrame(rows, "id long, t string")
    model = ds.fit_labels(df, "id", "t", labels, [], min_df=2, max_df=0.9, expand=5, share=0.5)
    want = _brute(rows, labels, 5, 0.5, 2, 0.9)
    got = {r.id: r for r in ds.score_labels(model, df, ["id"], "t").collect()}
    assert len(got) == len(rows)
    for i, w in want.items():
        assert all(abs(a - b) < 1e-8 for a, b in zip(got[i].cosines, w)), i
        p = [math.exp(x / model.temperature) for x in w]
        assert all(abs(a - b / sum(p)) < 1e-6 for a, b in zip(got[i].scores, p))
    assert got[500].cosines == [0.0] * 3 and max(got[500].scores) < 0.5
    multi = {r.id: r.scores for r in ds.score_labels(model, df, ["id"], "t", multi_label=True).collect()}
    means = [sum(w[i] for w in want.values()) / len(want) for i in range(3)]
    assert all(abs(s - 1 / (1 + math.exp((m - c) / model.temperature))) < 1e-6 for i in (0, 7, 500) for s, m, c in zip(multi[i], means, want[i]))


def test_labels_tell_languages_apart(spark):
    """The descriptions are five words of each language; most texts are longer
    than that and hold few of them, so the added terms matter."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") > 200)
    model = ds.fit_labels(docs, "doc_id", "text", PROBE_LABELS, PROBE_STOP_WORDS)
    assert model.temperature in ds.TEMPERATURES
    t = lb.top_label(F.col("scores"), model.names, 0.0)
    rows = ds.score_labels(model, docs, ["doc_id"], "text").select("doc_id", t["label"].alias("label")).join(
        docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "label").count().collect()
    best = {}
    for r in rows:
        if r.lang is not None:
            best.setdefault(r.lang, []).append((r["count"], r.label))
    right = sum(max(v)[0] for v in best.values())
    total = sum(n for v in best.values() for n, _ in v)
    assert len({max(v)[1] for v in best.values()}) == len(best) and right / total > 0.9, best


def test_chunks_and_edges(spark):
    rows = [(i, "aa bb " * 5 if i % 2 else "cc dd " * 5) for i in range(20)] + [(99, "aa " * 6 + "cc " * 6), (100, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    model = ds.fit_labels(df, "id", "t", {"one": "aa", "two": "cc"}, [], min_df=1, max_df=1.0)
    chunks = sorted((r.chunk_no, r.label) for r in ds.score_chunks(model, df, "id", "t", 6).where("id = 99").collect())
    assert chunks == [(0, "one"), (1, "two")]
    assert ds.score_chunks(model, df, "id", "t").where("id = 100").count() == 0
    assert ds.fit_labels(df, "id", "t", {"one": "aa"}, [], min_df=1, max_df=1.0, temperature=0.3).temperature == 0.3
    empty = ds.fit_labels(df.limit(0), "id", "t", {"one": "aa"}, [])
    assert {tuple(r.cosines) for r in ds.score_labels(empty, df, ["id"], "t").collect()} == {(0.0,)}
    with pytest.raises(ValueError):
        ds.fit_labels(df, "id", "t", {})


def test_unique_texts_are_scored_where_they_lie(spark):
    """Scoring shuffles no texts; rows that share a key count as one text."""
    rows = [(i, f"alpha beta{i % 3} beta{i % 3} gamma") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, t string")
    model = ds.fit_labels(df, "id", "t", {"a": "beta0 alpha", "b": "beta1"}, [], min_df=2, max_df=1.0)
    out = ds.score_labels(model, df, ["id"], "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.cosines for r in out.collect()}
    parted = df.select("id", F.explode(F.split("t", " ")).alias("t")).unionByName(spark.createDataFrame([(99, None), (99, "")], df.schema))
    got = {r.id: r.cosines for r in ds.score_labels(model, parted, ["id"], "t").collect()}
    assert got.pop(99) == [0.0, 0.0] and got == want

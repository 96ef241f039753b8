import random
from collections import Counter

import numpy as np

from tessera.llm import decontaminate as dc


def _shingles(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def _brute(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, it in items:
            own = (it or "").encode().lower().split()
            if not own:
                continue
            c, best = _shingles(own), 0.0
            for s in range(len(w) - len(own) + 1):
                x = _shingles(w[s:s + len(own)])
                both = sum((x & c).values())
                best = max(best, both / (sum(x.values()) + sum(c.values()) - both))
            if best >= dc.THRESHOLD:
                out[d, i] = round(best, 9)
    return out


def _got(df, bench):
    return {(r.id, r.item): round(r.similarity, 9) for r in dc.matches(df, bench).collect()}


def test_matches_brute_force(spark, docs):
    rnd = random.Random(2)
    voc = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(rnd.choice(voc) for _ in range(rnd.choice([1, 3, 5, 8, 20, 30, 50])))) for i in range(40)]
    rows = []
    for d in range(150):
        w = [rnd.choice(voc) for _ in range(rnd.randint(0, 120))]
        if d % 2:
            part = rnd.choice(items)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                part[rnd.randrange(len(part))] = rnd.choice(voc)
            p = rnd.randint(0, len(w))
            w[p:p] = part
        rows.append((d, " ".join(w).upper() if d % 4 == 1 else " ".join(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = _brute(rows, items)
    assert _got(docs(rows), bench) == want and len(want) > 50


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    ix = dc.Index(list(range(300)), [" ".join(f"i{i}x{k}" for k in range(20)) for i in range(300)])
    prints = ix.prints.copy()
    for r in range(len(prints)):
        for b in rng.choice(64, dc.RADIUS, replace=False):
            prints[r] ^= np.uint64(1) << np.uint64(b)
    w, i = ix.near(prints, 20)
    assert {(k, k) for k in range(300)} <= set(zip(w.tolist(), i.tolist()))


def test_edges(spark, docs):
    item = " ".join(f"t{i}" for i in range(20))
    rows = [(1, None), (2, ""), (3, "x " + item), (3, "x " + item), (None, item), (None, "clean"), (4, "z " * 200_000 + item),
            (5, "t0 t1 t2"), (6, item.upper()), (3, "another text"), (7, "t3 t4 t5 t6 t7 t8"), (8, "t3 t4 t5 t6 t7 t8 " * 3)]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item), (None, item)], "item_id long, text string")
    got = sorted((str(r.id), str(r.item), r.start) for r in dc.matches(docs(rows), bench).collect())
    each = [("1", 0), ("1", 0), ("None", 0)]
    assert got == sorted((d, i, s) for d, s in (("3", 1), ("3", 1), ("None", 0), ("4", 200_000), ("6", 0)) for i, _ in each)
    clean = dc.decontaminate(docs(rows), bench)
    assert sorted((str(r.doc_id), (r.text or "")[:7]) for r in clean.collect()) == [
        ("1", ""), ("2", ""), ("3", "another"), ("5", "t0 t1 t"), ("7", "t3 t4 t"), ("8", "t3 t4 t"), ("None", "clean")]
    assert clean.columns == docs(rows).columns
    assert dc.matches(docs(rows).limit(0), bench).count() == 0 and dc.matches(docs(rows), bench.limit(0)).count() == 0


def test_case_and_punctuation(spark, docs):
    item = "Élan vital, für die Öffnung: uno, dos y tres más allá."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dc.matches(docs([(1, "x " + item.upper().replace(",", " -") + " y")]), bench).collect()
    assert [(r.similarity, r.start, r.n_words) for r in got] == [(1.0, 1, 11)]


def test_items_in_several_passes(spark, docs, monkeypatch):
    items = [(i, " ".join(f"k{i}n{k}" for k in range(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, "pre " + t + " post") for i, t in items]
    whole = _got(docs(rows), bench)
    monkeypatch.setattr(dc, "ITEMS", 2)
    assert _got(docs(rows), bench) == whole and len(whole) == 9


def test_documents_shorter_than_the_item(spark, docs):
    """A whole document is compared with longer items: 86 of 96 and 76 of 96 shingles, but not 71 of 96."""
    w = [f"t{i}" for i in range(100)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:40]))], "item_id long, text string")
    rows = [(1, " ".join(w[:90])), (2, " ".join(w[20:])), (3, " ".join(w[25:])), (4, " ".join(w[:99]).upper()),
            (5, "a b c d e f g"), (6, " ".join(w[:4])), (7, " ".join(w[2:40]))]
    got = {(r.id, r.item): (round(r.similarity, 9), r.start, r.n_words) for r in dc.matches(docs(rows), bench).collect()}
    assert got == {(1, 1): (round(86 / 96, 9), 0, 90), (2, 1): (round(76 / 96, 9), 0, 80), (4, 1): (round(95 / 96, 9), 0, 99),
                   (1, 2): (1.0, 0, 40), (4, 2): (1.0, 0, 40), (7, 2): (round(34 / 36, 9), 0, 38)}
    clean = dc.decontaminate(docs(rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6]

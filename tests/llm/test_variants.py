import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import variants as v
from tessera.llm.q_variants import OP13_SQL, op13_variants


def _noisy(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 2}


def _near(words):
    held = set(words)
    alphabet = sorted({c for w in words for c in w})
    for w in words:
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in alphabet}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        yield w, (made & held) - {w}


def _brute(counts, ratio=10):
    forms, out = {}, {}
    near = dict(_near(counts))
    for w, ns in near.items():
        best = min(ns, key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, counts[w], len(near[w]), counts.get(forms[w]))
    return out


def _got(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def _vocabulary(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def _random_words(rnd, n, letters="ab", low=1, high=9):
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))): 10 ** rnd.randint(0, 4) + rnd.randint(0, 3) for _ in range(n)}


def test_search_finds_each_near_word_once():
    rnd = random.Random(1)
    words = sorted(_random_words(rnd, 400, "abc"))
    codes = [np.array([ord(c) - 95 for c in w]) for w in words]  # symbols from 2 on
    index = v.Index(codes)
    text = np.concatenate([[1]] + [x for c in codes for x in (c, [1])])
    size = np.array([len(c) for c in codes])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) + 1
    near = dict(_near(words))
    for shift in (0, 1):
        ask = np.flatnonzero(size - shift >= 1)
        for first in (True, False):
            s, w = v.search(index, text, begin[ask], size[ask], size[ask] - shift, first)
            pairs = [(words[ask[a]], words[b]) for a, b in zip(s, w)]
            assert len(set(pairs)) == len(pairs)
            for x in ask:
                u, m = words[x], size[x] - shift
                h = m // 2
                want = {y for y in near[u] if min(len(u), len(y)) == m and (y[:h] == u[:h] if first else y[len(y) - m + h:] == u[len(u) - m + h:])}
                assert {b for a, b in pairs if a == u} == want, (u, first, shift)


def test_suffix_intervals_agree_in_both_directions():
    rnd = random.Random(6)
    words = sorted(_random_words(rnd, 60, "ab", 2, 6))
    index = v.Index([np.array([ord(c) - 95 for c in w]) for w in words])
    body = "$" + "$".join(words) + "$"
    for pattern in ("ab", "$a", "ba$", "a$b", "bb"):
        lo, other, size = np.array([0]), np.array([0]), np.array([index.left.size])
        middle = len(pattern) // 2
        for c, right in [(c, True) for c in pattern[middle:]] + [(c, False) for c in reversed(pattern[:middle])]:
            key, owner, symbol, los, others, sizes = index.extensions(lo, other, size, right)
            k = np.flatnonzero(symbol == (1 if c == "$" else ord(c) - 95))
            lo, other, size = los[k], others[k], sizes[k]
        assert size[0] == sum(body.startswith(pattern, i) for i in range(len(body)))
        got = sorted(index.left.suffixes[lo[0]:lo[0] + size[0]])
        assert got == [i for i in range(len(body)) if body.startswith(pattern, i)]


@pytest.mark.parametrize("indexed", [1 << 17, 60])
def test_matches_brute_force(spark, monkeypatch, indexed):
    """Also with shards so small that halves are split over several."""
    monkeypatch.setattr(v, "INDEXED", indexed)
    monkeypatch.setattr(v, "SEARCHED", 3 * indexed)
    rnd = random.Random(indexed)
    counts = _random_words(rnd, 500) | _random_words(rnd, 100, "xyzé", 5, 12)
    want = _brute(counts)
    assert _got(v.variants(_vocabulary(spark, counts))) == want
    assert sum(x[0] is not None for x in want.values()) > 50 and any(x[0] != x[1] and x[0] for x in want.values())


def test_words(spark, docs):
    rows = [(i, "Überraschung information INFORMATION infor7mation d'information É÷×information informations " * 3) for i in range(60)]
    rows += [(None, "nothing nothing nothing"), (7, None), (8, ""), (9, "short abcdef"), (9, "repeated_repeated repeated"), (9, "repeated_repeated repeated")]
    rows += [(99, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 3000 + " " + "q" * 2999)]
    df = docs(rows)
    words = v.noisy_words(df)
    assert {r.word: r.n for r in words.collect()} == _noisy(rows)
    assert _got(v.variants(words)) == _brute(_noisy(rows))
    assert v.variants(v.noisy_words(df.limit(0))).count() == 0


def test_chain_of_forms(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcdjih": 1000, "zbcdjih": 99_999, "abcdefgx": 9, "lonesome": 5}
    got = _got(v.variants(_vocabulary(spark, counts)))
    assert got == _brute(counts) and got["abcdefg"][:2] == ("abcdefh", "zbcdjih") and got["lonesome"][1] == "lonesome"


def test_query_matches_brute_force_and_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = _got(op13_variants(spark, sf))
    assert got == _brute(_noisy(rows)) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert {r[0]: tuple(r[1:]) for r in con.execute(OP13_SQL).fetchall()} == got

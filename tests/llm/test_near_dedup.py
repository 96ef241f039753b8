import random

import numpy as np

from tessera.llm import near_dedup as nd


def _set(t):
    w = (t or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def _brute(rows):
    sets = [_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= 75 * union:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(sets[i]), low.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def _rows(seed=1, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        if rows and i % 3:
            w = (rnd.choice(rows)[1] or "x").split()
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 160))]
        rows.append((i * 3 % 1009, " ".join(w)))
    return rows


def _got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()),
                  key=str)


def test_matches_brute_force(docs):
    rows = _rows()
    want = sorted(((k, n, c, k is not None and k == c) for k, n, c in _brute(rows)), key=str)
    assert _got(docs(rows)) == want
    assert len({c for _, _, c, _ in want}) < len(want) - 20


def test_a_large_group_around_one_text(docs):
    """Copies that are each near one text, few of them near each other."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        w = list(base)
        for p in rnd.sample(range(120), 3):
            w[p] = f"x{rnd.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(w)))
    want = sorted(((k, n, c, k == c) for k, n, c in _brute(rows)), key=str)
    assert _got(docs(rows)) == want


def test_edges(docs):
    t = "a b c d e f g h"
    rows = [(1, None), (2, ""), (3, " \n\t"), (7, t), (7, t), (7, "other words entirely here now"), (9, t.upper()),
            (None, t), (None, "p q"), (4, "P  q"), (5, "long " * 30_000), (6, "long " * 40_000)]
    got = _got(docs(rows))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (7, 4, 7, True), (7, 4, 7, True),
                          (7, 1, 7, True), (9, 4, 7, False), (None, 4, 7, False), (None, 1, 4, False),
                          (4, 1, 4, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)
    assert _got(docs(rows).limit(0)) == []


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    same = rng.random((4000, nd.HASHES)) < 0.75
    left = rng.integers(0, 1 << 16, same.shape).astype(np.uint16)
    right = np.where(same, left, left + 1)
    assert len(nd.likely(left, right)) >= 3998
    unlike = np.where(rng.random(same.shape) < 0.3, left, left + 1)
    assert len(nd.likely(left, unlike)) == 0

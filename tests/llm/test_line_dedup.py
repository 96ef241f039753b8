import random

from tessera.llm.line_dedup import dedup_lines


def _brute(rows):
    first = {}
    order = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    lines = {r: (r[1] or "").split("\n") for r in order}
    for r in order:
        ls = lines[r]
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            if any(x.strip(" ") for x in w):
                first.setdefault(w, (r, p))
    out = {}
    for r in order:
        ls, gone = lines[r], set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p:p + 3])
            if any(x.strip(" ") for x in w) and first[w] != (r, p):
                gone |= {p, p + 1, p + 2}
        out[r] = (r[1] if not gone else "\n".join(x for p, x in enumerate(ls) if p not in gone), len(ls), len(gone))
    return out


def test_matches_brute_force(docs):
    rnd = random.Random(5)
    rows = [(i, "\n".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 12)))) for i in range(200)]
    rows += [(900, "\n".join(str(k % 7) for k in range(3000))), (901, None), (902, ""), (903, "\n\n\n\n")]
    df = docs(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(df).collect()}
    want = {k[0]: v for k, v in _brute(rows).items()}
    assert got == want and sum(v[2] for v in want.values()) > 300


def test_edges(docs):
    a = "one\ntwo\nthree"
    rows = [(5, a), (5, a), (5, a + "\nfour"), (None, a), (None, "x\ny\nz"), (3, a + "\nlast")]
    got = sorted((str(r.doc_id), r.text, r.n_removed, r.spans) for r in dedup_lines(docs(rows)).collect())
    assert got == [("3", a + "\nlast", 0, "mine"), ("5", "", 3, "mine"), ("5", "", 3, "mine"),
                   ("5", "four", 3, "mine"), ("None", "", 3, "mine"), ("None", "x\ny\nz", 0, "mine")]
    assert dedup_lines(docs(rows).limit(0)).count() == 0
    assert dedup_lines(docs([(1, a), (1, a)])).where("n_removed > 0").count() == 0

from tessera.llm.mixing import emit, mix, source_rates


def _targets(sizes, weights=(3, 1, 2)):
    """Deal and deal again until no target is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    want, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = (want - sum(out.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not over:
            out.update({s: weight[s] * level for s in open_})
            break
        out.update({s: 2.0 * sizes[s] for s in over})
        open_ -= over
    return out


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 7, None: 90, "é": 0, "Z": 4000}
    rows = [(s, n) for s, n in sizes.items()] + [("a", 0)]
    got = {r.source: (r.source_size, r.target) for r in source_rates(
        spark.createDataFrame(rows, "source string, size long")).collect()}
    want = _targets(sizes)
    assert {s: v[0] for s, v in got.items()} == sizes
    assert all(abs(got[s][1] - want[s]) < 1e-9 for s in sizes)
    assert abs(sum(v[1] for v in got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def test_mix(docs):
    rows = [(i, "w " * (5 + i % 40), ["a", "b", None][i % 3] if i % 5 else "a") for i in range(3000)]
    df = docs(rows)
    got = mix(df).collect()
    again = {(r.doc_id, r.taken) for r in mix(df.repartition(7)).collect()}
    assert {(r.doc_id, r.taken) for r in got} == again
    by = {}
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % r.size == 0 and r.size == 5 + r.doc_id % 40
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) < 0.05 * b for a, b in by.values())
    copies = emit(mix(df)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in copies} == {r.doc_id: r.copies for r in got if r.copies}


def test_edges(docs):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t  \n", "b"), (3, "x y", None), (3, "x y", None), (None, "q", None)]
    got = sorted((str(r.doc_id), r.size, str(r.source), r.spans) for r in mix(docs(rows)).collect())
    assert got == [("1", 0, "a", "mine"), ("2", 0, "a", "mine"), ("3", 1, "b", "mine"), ("3", 2, "None", "mine"),
                   ("3", 2, "None", "mine"), ("None", 1, "None", "mine")]
    assert mix(docs(rows).limit(0)).count() == 0 and emit(mix(docs(rows).limit(0))).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mix(docs([(1, None), (2, "")])).collect())


def test_targets_met_without_ids_and_with_shared_ids(docs):
    rows = [(None, f"w{i} " * 25, "a") for i in range(2000)] + [(7, f"v{i} " * 25, "b") for i in range(2000)]
    by = {}
    for r in mix(docs(rows)).collect():
        t = by.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) < 0.05 * b for a, b in by.values()), by

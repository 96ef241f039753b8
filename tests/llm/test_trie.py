import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import trie
from tessera.llm.q_trie import OP12_SQL, op12_prefix_trie
from tessera.llm.registry import ORACLE

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}


def _rebuilt(rows):
    own = _turns(rows)
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def _brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids[p]]
        leaves = sum(b[0] for b in below) if below else 1
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (leaves, own + sum(b[1] for b in below))
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids[p]), *sums[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _frame(spark, rows):
    full = [(*r, "mine", b"x", 3) for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, node string, path binary, depth int")


def _got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def _convs(spark, convs):
    """Conversations as they are, not rebuilt."""
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    return trie.ordered(_frame(spark, rows))


def test_matches_brute_force(spark):
    rnd = random.Random(2)
    rows = []
    for c in list(range(120)) + list(range(300, 340)) + [1000, 1007, 1007 + 100]:
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "é😀"])))
    want = _brute(_rebuilt(rows))
    assert _got(trie.prefix_trie(trie.rebuild(trie.ordered(_frame(spark, rows))))) == want and len(want) > 300


def test_many_branches_on_one_path(spark):
    """Each conversation leaves the one before a turn later: edges are cut in many places."""
    convs = {k: [("u", str(i)) for i in range(k)] + [("u", f"own {k}")] for k in range(1, 70)}
    convs[500] = [("u", str(i)) for i in range(40)]
    convs |= {600 + k: list(convs[33]) for k in range(300)}
    assert _got(trie.prefix_trie(_convs(spark, convs))) == _brute(convs)


def test_search_finds_the_exit(spark):
    rnd = random.Random(4)
    convs = {c: [("u", rnd.choice("ab")) for _ in range(rnd.randint(1, 12))] for c in range(150)}
    held = {c: ts for c, ts in convs.items() if c % 2}
    known = trie.paths(_convs(spark, held)).dropDuplicates(["end"])
    nodes, _ = trie.build(known)
    prefixes = {tuple(ts[:d]) for ts in held.values() for d in range(len(ts) + 1)}
    asked = trie.paths(_convs(spark, convs))
    found = trie.locate(nodes, asked.dropDuplicates(["end"])).join(asked.select("conv_id", "end"), "end").collect()
    assert len(found) == len(convs)
    for r in found:
        ts = convs[r.conv_id]
        assert r.common == max(d for d in range(len(ts) + 1) if tuple(ts[:d]) in prefixes)


@pytest.mark.parametrize("low, high", [(0, 1), (0, 7), (3, 7), (4, 7), (5, 6), (8, 13), (0, 398), (399, 400)])
def test_fattest(spark, low, high):
    got = spark.range(1).selectExpr(f"{low} AS l", f"{high} AS r").selectExpr(f"{trie._fattest('l', 'r')} AS f").first().f
    assert got == max(range(low + 1, high + 1), key=lambda x: x & -x)


def test_edges(spark):
    rows = [(0, None, "u", "x"), (0, 1, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (None, 0, "u", "lost"),
            (101, 3, "u", "long " * 50_000), (5, 0, "u", "y"), (205, 0, "u", "y"), (-7, 1, "a", "z"), (-100, 1, "a", "q")]
    df = _frame(spark, rows)
    got = _got(trie.prefix_trie(trie.rebuild(trie.ordered(df))))
    convs = {c: ts for c, ts in _rebuilt(rows).items() if c >= 0}
    # Spark's and Java's remainder of a negative id is negative, Python's is not.
    neg = {c: ts for c, ts in _turns(rows).items() if c < 0}
    for c, ts in neg.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = _turns(rows).get(-100 if c == -100 else 0, [])[:h] + ts[h:]
    assert got == _brute(convs)
    assert any(d == 0 and s != hashlib.sha256(b"").hexdigest() for _, d, *_, s in got), "a turnless conversation"
    assert trie.prefix_trie(trie.rebuild(trie.ordered(df.limit(0)))).count() == 0
    only = trie.prefix_trie(trie.ordered(df.limit(0)).union(spark.createDataFrame([(3, [])], "conv_id long, turns array<struct<h: binary, n: int>>")))
    assert _got(only) == _brute({3: []})


def test_query_matches_brute_force_and_sql(spark):
    import duckdb
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = op12_prefix_trie(spark, sf)
    assert df.columns == COLS and _got(df) == _brute(_rebuilt(rows))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    assert ORACLE["op12_prefix_trie"] == OP12_SQL
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == _got(df)

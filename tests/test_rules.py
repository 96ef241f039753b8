"""The rules against a plain Python version, word by word."""

import math
import random

import pytest

from tessera.operators import labels as lb
from tessera.operators import rules as rl
from tessera.session import stage_table

R = rl.Rules(negators=("not", "never"), stronger=("very", "so"), weaker=("barely",), contrast=("but",))
LEX = {"good": 2.0, "great": 3.0, "bad": -2.5, "awful": -3.5, "fine": 0.0}
POL = {"good": (0.7, 0.6), "bad": (-0.7, 0.67), "great": (0.8, 0.75)}


def _core(w):
    return w.strip(rl.PUNCTUATION).lower()


def _chunk(ws, plain):
    cores = [_core(w) for w in ws]
    turn = next((i for i, c in enumerate(cores) if c in R.contrast), None)
    s = 0.0
    for i, (w, c) in enumerate(zip(ws, cores)):
        if c not in LEX:
            continue
        v = LEX[c]
        sign = (v > 0) - (v < 0)
        if plain and len(c) > 1 and w.upper() == w and w.lower() != w:
            v += sign * R.capitals
        back = [cores[i - j] if i >= j else None for j in (1, 2, 3)]
        v += sign * sum(R.boost * f if b in R.stronger else -R.boost * f if b in R.weaker else 0.0 for b, f in zip(back, R.fading))
        v *= R.negation if any(b in R.negators for b in back) else 1.0
        if turn is not None:
            v *= R.before if i < turn else R.after if i > turn else 1.0
        s += v
    marks = min(sum(w.count("!") for w in ws), R.exclamations)
    s += ((s > 0) - (s < 0)) * marks * R.exclamation
    return s / math.sqrt(s * s + R.alpha)


def _sentiment(text, size):
    ws = (text or "").split()
    if not ws:
        return None
    plain = any(c.islower() for c in text)
    chunks = [_chunk(ws[i:i + size], plain) for i in range(0, len(ws), size)]
    return sum(chunks) / len(chunks)


def _polarity(text):
    cores = [_core(w) for w in (text or "").split()]
    p, q = [], []
    for i, c in enumerate(cores):
        if c in POL:
            one, two = (cores[i - j] if i >= j else None for j in (1, 2))
            f = R.more if one in R.stronger else R.fewer if one in R.weaker else 1.0
            turned = one in R.negators or (f != 1.0 and two in R.negators)
            p.append(max(-1.0, min(1.0, POL[c][0] * f)) * (R.reversal if turned else 1.0))
            q.append(max(0.0, min(1.0, POL[c][1] * f)))
    return (sum(p) / len(p), sum(q) / len(q)) if p else (0.0, 0.0)


def _texts(n):
    rnd = random.Random(11)
    pool = ["good", "Good!", "GREAT", "bad,", "awful", "fine", "not", "never", "VERY", "so", "barely", "but", "But,", "x", "y!!", "\"great\"", "…", "BUT"]
    rows = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return rows + [None, "", "  \n ", "GOOD BAD VERY GREAT", "not " * 5 + "good", "good " * 900]


@pytest.mark.parametrize("size", [4, 300])
def test_sentiment_equals_plain_python(spark, size):
    texts = _texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    lex = spark.createDataFrame(list(LEX.items()), "word string, weight double")
    got = {r.id: r for r in rl.rule_sentiment(df, "id", "t", lex, R, size).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = _sentiment(t, size)
        if want is None:
            assert got[i].score is None and got[i].label == "neutral"
        else:
            assert abs(got[i].score - want) < 1e-9, (t, got[i], want)
            assert got[i].label == ("positive" if want >= 0.05 else "negative" if want <= -0.05 else "neutral")


def test_order_decides(spark):
    lex = spark.createDataFrame(list(LEX.items()), "word string, weight double")
    texts = ["good not", "not good", "very good", "bad but good", "good but bad", "good!", "GOOD thing"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    s = {texts[r.id]: r.score for r in rl.rule_sentiment(df, "id", "t", lex, R).collect()}
    assert s["not good"] < 0 < s["good not"] < s["very good"]
    assert s["bad but good"] > 0 > s["good but bad"]
    assert s["good!"] > s["good not"] and s["GOOD thing"] > s["good not"]


def test_polarity_equals_plain_python(spark):
    texts = _texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    lex = spark.createDataFrame([(w, p, q) for w, (p, q) in POL.items()], "word string, polarity double, subjectivity double")
    rows = rl.rule_polarity(df, "id", "t", lex, R).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p, q = _polarity(texts[r.id])
        assert abs(r.tb_polarity - p) < 1e-9 and abs(r.tb_subjectivity - q) < 1e-9
        assert r.tb_sentiment == ("positive" if p > 0.05 else "negative" if p < -0.05 else "neutral")


def test_query_sentiment_by_rules(spark):
    lex = spark.createDataFrame([(w, p, q) for w, (p, q) in POL.items()], "word string, polarity double, subjectivity double")
    q = spark.createDataFrame([(1, "not good " + "x" * 1000 + " great")], "id long, q string")
    r = lb.query_sentiment(q, "id", "q", lex, polarity=lambda d, i, t, x: rl.rule_polarity(d, i, t, x, R)).first()
    assert round(r.query_polarity, 6) == -0.35 and r.query_sentiment_label == "negative"


def test_no_exchange_before_the_lexicon_is_joined(spark):
    """Every word meets the lexicon in the stage that reads the texts."""
    df = spark.createDataFrame([(1, "a b")], "id long, t string")
    lex = stage_table(spark.createDataFrame(list(LEX.items()), "word string, weight double"), "lexicon")  # of known size
    plan = rl.rule_sentiment(df, "id", "t", lex, R)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # chunks, then texts

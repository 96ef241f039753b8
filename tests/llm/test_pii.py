import random
import re

from pyspark.sql import functions as F

from tessera.llm import pii


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def _spans(df):
    return {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.joined(F.col("spans")).alias("s")).collect()}


def test_base_spans_match_brute_force(docs):
    rnd = random.Random(3)
    texts = ["a@b.c_x@d.e é 😀 foo.bar+z@x-y.co.uk. 1.2.3.4 001.02.255.256 1.2.3.4.5",
             "card 4111 1111 1111 1111 and 4111-1111-1111-1112 tel +49 (30) 1234-5678 x", "a.b@c.de 10.0.0.1 " * 300]
    texts += ["".join(rnd.choice("ab1 1.@-+()é😀24") for _ in range(60)) for _ in range(400)]
    got = _spans(docs(list(enumerate(texts))))
    for i, t in enumerate(texts):
        base = [x for x in got[i].split(",") if x.split(":")[0] in pii.BASE]
        assert base == [":".join(map(str, x)) for x in _brute(t)], t


def test_checksums_and_context(docs):
    rows = [(1, "ship to DE89 3704 0044 0532 0130 00, please"), (2, "DE89 3704 0044 0532 0130 01"),
            (3, "my ssn is 123-45-6789"), (4, "part 123-45-6789 of it")]
    got = _spans(docs(rows))
    assert got == {1: "iban:8:35", 2: "", 3: "ssn:10:21", 4: ""}


def test_edges(spark, docs):
    long = [(1, None), (2, ""), (3, "1 " * 200_000), (4, "a@b" + ".c" * 50_000), (5, "7" * 200_000 + "." + "8" * 9),
            (6, "q." * 100_000 + "@"), (7, "+1" + " " * 100_000), (7, "x@y.zz"), (7, "x@y.zz"), (None, "x@y.zz")]
    df = pii.find_pii(docs(long))
    assert df.columns.count("spans") == 1 and df.count() == 10
    by = {}
    for r in df.select("doc_id", pii.joined(F.col("spans")).alias("s")).collect():
        by.setdefault(r.doc_id, []).append(r.s)
    assert by[1] == by[2] == by[6] == [""] and by[4] == ["email:0:100003"]
    assert sorted(by[7]) == ["", "email:0:6", "email:0:6"] and by[None] == ["email:0:6"]
    assert pii.find_pii(docs([(1, "a")]).limit(0)).count() == 0


def test_main_path_has_no_python(docs):
    plan = pii.find_pii(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

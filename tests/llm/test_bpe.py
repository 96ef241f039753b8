import base64
import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe
from tessera.llm.q_bpe import op11_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TABLE = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, TABLE.splitlines())}
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(TABLE, bpe.classes())


def _ids(text):
    return np.frombuffer(CODEC.encode(pa.array([text]))[0].as_py(), "<u4").tolist()


def _matches(text):
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    starts = CODEC.starts(codes, np.array([0, len(text)])).tolist()
    return [text[a:b] for a, b in zip(starts, starts[1:] + [len(text)])]


@pytest.fixture()
def small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 3)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 1)
    yield


def _texts(n, seed=3):
    rnd = random.Random(seed)
    kinds = ["abcdefghilmnoprstu", "'srelvtdm", " \t\n 　", "0123456789²", ".,;!?-#", "äöüßéè", "日本語中文", "😀🏳️‍🌈́"]
    for _ in range(n):
        yield "".join("".join(rnd.choice(k) for _ in range(rnd.randint(1, 6)))
                      for k in rnd.choices(kinds, k=rnd.randint(0, 25)))


def test_equals_the_library(small_leaves):
    for text in _texts(1500):
        assert _ids(text) == WANT.encode_ordinary(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text("ab 'sl\n1.", max_size=120))
def test_any_text(text):
    was, bpe.LEAF_CHARS, bpe.LEAF_BYTES = (bpe.LEAF_CHARS, bpe.LEAF_BYTES), 2, 1
    try:
        assert _ids(text) == WANT.encode_ordinary(text)
        assert CODEC.decode(np.array(_ids(text), np.int64)) == text.encode()
        if not any(unicodedata.category(c) == "Cn" for c in text):  # the regex module knows later characters
            assert _matches(text) == regex.findall(P.PATTERN, text)
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES = was


def test_halves_join_at_every_place():
    words = ["undinformation", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "=-=-=-=-===----", "ééééàààà", "日本語日本語"]
    for data in (w.encode() for w in words):
        whole = CODEC.merge(data)
        for cut in range(1, len(data)):
            assert CODEC.join(CODEC.merge(data[:cut]), CODEC.merge(data[cut:])) == whole


def test_many_matches_at_once():
    rnd = random.Random(9)
    data = [bytes(rnd.choice(b"aeinorst \xc3\xa9\xa4") for _ in range(rnd.randint(1, 32))) for _ in range(3000)]
    ids, count = CODEC.merge_many(np.frombuffer(b"".join(data), np.uint8), np.array([len(d) for d in data]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [CODEC.merge(d) for d in data]


def test_matches_are_the_patterns():
    assert bpe.PATTERN == P.PATTERN
    for text in _texts(3000, 12):
        assert _matches(text) == regex.findall(P.PATTERN, text), text


def test_characters_of_all_kinds():
    """Every fifth code point between letters, numbers and others."""
    points = [c for c in range(0, 0x110000, 5) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 2048):
        texts = [f"a{c}a1{c}1.{c}. {c}{c} x" for c in map(chr, points[i:i + 2048])]
        got = [np.frombuffer(x, "<u4").tolist() for x in CODEC.encode(pa.array(texts)).to_pylist()]
        assert got == WANT.encode_ordinary_batch(texts, num_threads=2)


def test_many_texts_at_once(small_leaves, monkeypatch):
    """Texts in one slice and over several, with nulls and empty ones between."""
    texts = list(_texts(600, 21)) + [None, "", "'", "s", "'", "ll", " ", "x", None]
    for size in (1, 100, 1 << 22):
        monkeypatch.setattr(bpe, "SLICE", size)
        got = CODEC.encode(pa.array(texts))
        assert [np.frombuffer(g, "<u4").tolist() for g in got.to_pylist()] == [WANT.encode_ordinary(t or "") for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe, "_HASH", np.zeros(256, np.uint64))
    text = "the cat sat on the mat and that hat"
    assert _ids(text) == WANT.encode_ordinary(text)


def test_neighbours_of_an_encoding_fit():
    ids = CODEC.merge(b"theinformationofinternationalcooperation")
    assert all(CODEC.fits(a, b) for a, b in zip(ids, ids[1:]))
    assert not CODEC.fits(RANKS[b"t"], RANKS[b"h"])


def test_long_matches_and_texts():
    rnd = random.Random(8)
    for text in ("a" * 30_001, " " * 20_000 + "x", "".join(rnd.choice("etaoinshr") for _ in range(60_000)),
                 "9" * 9_999 + "!" * 9_999, "".join(_texts(400, 5))):
        assert _ids(text) == WANT.encode_ordinary(text)


def test_documents(spark):
    for sf in ("sf0.001",):
        path = f"/root/testdata/{sf}"
        rows = op11_bpe(spark, path).collect()
        texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
        assert len(rows) == len(texts)
        for r in rows:
            ids = WANT.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark, docs):
    vocabulary = bpe.Vocabulary(spark, PATH)
    df = docs([(1, None), (2, ""), (3, "it's 12  x"), (3, "it's 12  x"), (None, "a"), (4, "<|endoftext|>")])
    df = df.selectExpr("*", "'mine' AS ids", "-1 AS n_tokens", "'mine' AS decoded")
    out = bpe.decode(bpe.encode(df, vocabulary), vocabulary)
    rows = out.collect()
    assert sorted(out.columns) == sorted(df.columns) and len(rows) == 6
    assert all(r.n_tokens == len(WANT.encode_ordinary(r.text or "")) for r in rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.spans == "mine" for r in rows)
    assert bpe.encode(df.limit(0), vocabulary).count() == 0


def test_bad_vocabulary(spark, tmp_path):
    f = tmp_path / "ranks"
    f.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.Vocabulary(spark, str(f))
    line = base64.b64encode(b"qzqzqz") + b" 99999\n"
    f.write_bytes(TABLE.rstrip(b"\n") + b"\n" + line)
    with pytest.raises(ValueError, match="99999"):
        bpe.Vocabulary(spark, str(f))

import numpy as np
import pyarrow as pa

from tessera.llm import words as W


def _words(texts):
    out = []
    for i, j, h, d, s, e in W.words(pa.array(texts, pa.string())):
        at = W.bounds(d, j - i)
        for k in range(j - i):
            raw = (texts[i + k] or "").encode()
            cut = slice(at[k], at[k + 1])
            out.append((h[cut], [raw[a:b] for a, b in zip(s[cut], e[cut])]))
    return out


def test_words_are_cut_at_ascii_white_space():
    texts = ["a b", "", None, " A  b\n", "x\ty\x0bz  ", "é b c", "q", "   "]
    for text, (_, found) in zip(texts, _words(texts)):
        assert found == (text or "").encode().split()


def test_equal_words_hash_alike_wherever_they_stand():
    long = "pad " * 600_000 + "Word " + "w" * 3_000_000 + " tail"
    found = _words(["word tail", long, "W" * 3_000_000])
    assert found[0][0][0] == found[1][0][-3] and found[0][0][1] == found[1][0][-1]
    assert found[1][0][-2] == found[2][0][0]
    assert len(found[1][0]) == 600_003


def test_shingles():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(W.shingles(h)) == 3 and len(W.shingles(h[:5])) == 1
    assert len(W.shingles(h[:2])) == 1 and len(W.shingles(h[:0])) == 0
    assert W.shingles(h[:2])[0] != W.shingles(h[:3])[0]

"""Words and shingles of whole Arrow text columns as 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Everything is vectorised over slices of about ``SEGMENT`` bytes, so memory is
bounded whatever the batch holds; a longer document is cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEGMENT = 1 << 20
SHINGLE = 5

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
# One random 64-bit value per (lower-cased) byte.
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)[_FOLD]
_BASE = 0x9E3779B97F4A7C15
_TABLES: list[np.ndarray] = []
_POSITION = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _TABLES:
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(2 * SEGMENT + 2, b, np.uint64)
            t[0] = 1
            _TABLES.append(np.cumprod(t, dtype=np.uint64))
    return _TABLES[0], _TABLES[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    return off, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def _segment(data: np.ndarray, off: np.ndarray):
    """Word hashes, document indexes and byte spans of documents that lie one
    after the other in ``data``."""
    space = _IS_SPACE[data]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    begin = off[:-1][off[:-1] < len(data)]
    first[begin] = word[begin]
    end = off[1:][off[1:] > 0] - 1
    last[end] = word[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _tables()
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:len(data)], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(off, starts, side="right") - 1, starts, ends


def _long(data: np.ndarray):
    """The words of one document above ``SEGMENT`` bytes."""
    parts, at = [], 0
    while at < len(data):
        cut = min(at + SEGMENT, len(data))
        while cut < len(data):
            gap = np.flatnonzero(_IS_SPACE[data[cut:cut + SEGMENT]])
            if len(gap):
                cut += int(gap[0])
                break
            cut = min(cut + SEGMENT, len(data))
        piece = data[at:cut]
        if len(piece) > 2 * SEGMENT or (cut - at > SEGMENT and not _IS_SPACE[piece[-SEGMENT:]].any()):
            # The piece ends with a word longer than SEGMENT: hash that one apart.
            gap = np.flatnonzero(_IS_SPACE[piece])
            cut_word = int(gap[-1]) + 1 if len(gap) else 0
            if cut_word:
                h, _, s, e = _segment(piece[:cut_word], np.array([0, cut_word]))
                parts.append((h, s + at, e + at))
            raw = _FOLD.astype(np.uint8)[piece[cut_word:]].tobytes()
            parts.append((np.array([xxhash.xxh64_intdigest(raw)], np.uint64),
                          np.array([at + cut_word]), np.array([cut])))
        else:
            h, _, s, e = _segment(piece, np.array([0, len(piece)]))
            parts.append((h, s + at, e + at))
        at = cut
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, np.zeros(len(h), np.int64), s, e


def words(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices ``(i, j, hashes, documents, starts, ends)`` of a text column:
    the words of rows i to j - 1, ``documents`` counted from i, byte spans from
    the start of each document."""
    off, data = text_buffer(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + SEGMENT, side="right")) - 1
        j = min(max(j, i + 1), n)
        piece = data[off[i]:off[j]]
        if len(piece) > SEGMENT:
            h, d, s, e = _long(piece)
        elif len(piece):
            own = off[i:j + 1] - off[i]
            h, d, s, e = _segment(piece, own)
            s, e = s - own[d], e - own[d]
        else:
            h, d = np.empty(0, np.uint64), np.empty(0, np.int64)
            s = e = d
        yield i, j, h, d, s, e
        i = j


def bounds(documents: np.ndarray, n: int) -> np.ndarray:
    """Where each document's items begin, n + 1 values."""
    return np.searchsorted(documents, np.arange(n + 1))


def combine(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items (positions 0 to len - k)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = h[:m] * _POSITION[0]
    for i in range(1, k):
        total = total + h[i:i + m] * _POSITION[i]
    return mix(total)


def shingles(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Shingle hashes of one document, in order; with fewer than k words the
    whole sequence is one shingle, without words there is none."""
    if len(h) >= k or not len(h):
        return combine(h, k)
    return mix(combine(h, len(h)) + np.uint64(len(h)))

"""Benchmark decontamination by SimHash over item-sized windows.

Each benchmark item has a 64-bit SimHash of its words.  Where a document
shares a shingle with an item, its windows of that item's length are
fingerprinted; a multi-index over four 16-bit blocks, each searched to radius
3, finds every item within ``RADIUS`` bits (if all four blocks differed by four
bits or more, the distance would be 16 at least).  Candidates are verified by
the exact weighted Jaccard similarity of their five-word shingles.  A window
without any shared shingle has similarity 0, so none is lost by not being
fingerprinted.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import ROW, pack, stage, unpack

THRESHOLD = 0.75
RADIUS = 15
BLOCKS, BITS = 4, 16
#: Items (and characters of items) of one pass over the documents.
ITEMS, CHARS = 50_000, 16 << 20
FILTER_BITS = 22

_NEAR = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1)
                  for c in itertools.combinations(range(BITS), r)], np.int64)


def _signs(h: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each word hash."""
    return np.unpackbits(W.mix(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Shingle hashes at every position: of five words, or of a whole item of
    k < 5 words."""
    return W.combine(h, k) if k >= W.SHINGLE else W.mix(W.combine(h, k) + np.uint64(k))


class Index:
    """Items of one pass: sizes, shingle weights, anchors and the multi-index."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, hashes = [], []
        if texts:
            for i, j, h, d, _, _ in W.words(pa.array(texts, pa.large_string())):
                at = W.bounds(d, j - i)
                for k in range(j - i):
                    if at[k + 1] > at[k]:
                        self.ids.append(ids[i + k])
                        hashes.append(h[at[k]:at[k + 1]])
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        self.sets = [np.unique(W.shingles(h), return_counts=True) for h in hashes]
        self.prints = (np.concatenate([_fingerprint(_signs(h).sum(axis=0)[None, :]) for h in hashes])
                       if hashes else np.empty(0, np.uint64))
        #: per shingle width: sorted shingles, the items that hold each, and a bit filter
        self.anchors = {}
        for k in np.unique(np.minimum(self.sizes, W.SHINGLE)).tolist():
            own = [i for i in range(len(hashes)) if min(len(hashes[i]), W.SHINGLE) == k]
            grams = np.concatenate([self.sets[i][0] for i in own])
            item = np.repeat(own, [len(self.sets[i][0]) for i in own])
            order = np.argsort(grams, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[grams >> np.uint64(64 - FILTER_BITS)] = True
            self.anchors[k] = (grams[order], item[order], seen)
        parts = self._parts(self.prints)
        self.order = [np.argsort(p, kind="stable") for p in parts]
        self.starts = [np.searchsorted(p[o], np.arange((1 << BITS) + 1)) for p, o in zip(parts, self.order)]

    @staticmethod
    def _parts(prints: np.ndarray) -> list[np.ndarray]:
        return [((prints >> np.uint64(BITS * b)) & np.uint64((1 << BITS) - 1)).astype(np.int64) for b in range(BLOCKS)]

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of the given size within the radius."""
        windows, items = [], []
        for b, part in enumerate(self._parts(prints)):
            keys = part[:, None] ^ _NEAR[None, :]
            lo, hi = self.starts[b][keys], self.starts[b][keys + 1]
            w, r = np.nonzero(hi > lo)
            first, count = lo[w, r], (hi - lo)[w, r]
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            windows.append(np.repeat(w, count))
            items.append(self.order[b][at])
        w, i = np.concatenate(windows), np.concatenate(items)
        fits = self.sizes[i] == size
        w, i = w[fits], i[fits]
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        if not close.any():
            return w[:0], i[:0]
        return tuple(np.unique(np.stack([w[close], i[close]]), axis=1))

    def similarity(self, h: np.ndarray, item: int) -> float:
        grams, counts = np.unique(W.shingles(h), return_counts=True)
        own, weights = self.sets[item]
        _, x, y = np.intersect1d(grams, own, assume_unique=True, return_indices=True)
        both = int(np.minimum(counts[x], weights[y]).sum())
        return both / (int(counts.sum()) + int(weights.sum()) - both)

    def windows(self, n: int, hits: dict[int, list[int]]) -> Iterator[tuple[int, np.ndarray]]:
        """Window starts per size in a document of n words, from the positions
        of shared shingles: all windows that contain one; none where the
        document is shorter (see ``whole``)."""
        for size, spots in hits.items():
            if n < size:
                continue
            k = min(size, W.SHINGLE)
            mark = np.zeros(n + 2, np.int64)
            for p in spots:
                mark[max(0, p - size + k)] += 1
                mark[min(p, n - size) + 1] -= 1
            starts = np.flatnonzero(np.cumsum(mark)[:n - size + 1] > 0)
            if len(starts):
                yield size, starts

    def whole(self, h: np.ndarray) -> Iterator[tuple[float, int]]:
        """(similarity, item) of the longer items that match a whole document."""
        if len(h) < W.SHINGLE or W.SHINGLE not in self.anchors:
            return
        grams, item, _ = self.anchors[W.SHINGLE]
        own, counts = np.unique(W.shingles(h), return_counts=True)
        lo, hi = np.searchsorted(grams, own, side="left"), np.searchsorted(grams, own, side="right")
        n = hi - lo
        held = item[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        items, at = np.unique(held, return_inverse=True)
        # at most what the document holds of the shared shingles
        both = np.bincount(at, np.repeat(counts, n), len(items))
        fits = (self.sizes[items] > len(h)) & (both >= THRESHOLD * (self.sizes[items] - W.SHINGLE + 1))
        for i in items[fits].tolist():
            value = self.similarity(h, i)
            if value >= THRESHOLD:
                yield value, i

    def search(self, h: np.ndarray, hits: dict[int, list[int]]) -> dict[int, tuple[float, int, int]]:
        """Best window (similarity, start, distance) of each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        if any(size > len(h) for size in hits):
            print_ = _fingerprint(_signs(h).sum(axis=0)[None, :])[0]
            for value, i in self.whole(h):
                best[i] = (value, 0, int(np.bitwise_count(print_ ^ self.prints[i])))
        for size, starts in self.windows(len(h), hits):
            for cut in range(0, len(starts), 512):
                some = starts[cut:cut + 512]
                base = int(some[0])
                sums = np.zeros((int(some[-1]) - base + size + 1, 64), np.int32)
                np.cumsum(_signs(h[base:int(some[-1]) + size]), axis=0, out=sums[1:])
                prints = _fingerprint(sums[some - base + size] - sums[some - base])
                for w, i in zip(*(x.tolist() for x in self.near(prints, size))):
                    s = int(some[w])
                    value = self.similarity(h[s:s + size], i)
                    if value >= THRESHOLD and (i not in best or value > best[i][0]):
                        best[i] = (value, s, int(np.bitwise_count(prints[w] ^ self.prints[i])))
        return best

    def scan(self, col: pa.Array) -> Iterator[tuple[int, int, dict[int, tuple[float, int, int]]]]:
        """(row, words, matches) of the rows of a text column that match an item."""
        for i, j, h, d, _, _ in W.words(col):
            at = W.bounds(d, j - i)
            found: dict[int, dict[int, list[int]]] = {}
            for k, (grams, item, seen) in self.anchors.items():
                if len(h) < k:
                    continue
                g = _grams(h, k)
                p = np.flatnonzero(seen[g >> np.uint64(64 - FILTER_BITS)] & (d[:len(g)] == d[k - 1:]))
                lo = np.searchsorted(grams, g[p], side="left")
                hi = np.searchsorted(grams, g[p], side="right")
                for q, x, y in zip(p[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    own = found.setdefault(int(d[q]), {})
                    for size in np.unique(self.sizes[item[x:y]]).tolist():
                        own.setdefault(size, []).append(q - int(at[d[q]]))
            for row, hits in sorted(found.items()):
                match = self.search(h[at[row]:at[row + 1]], hits)
                if match:
                    yield i + row, int(at[row + 1] - at[row]), match


def _plain(text: Column) -> Column:
    """Lower-cased letters and digits, anything between them as one space: case
    and punctuation hide no passage."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def _passes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes over blocks of items of bounded size."""
    items = benchmark.select(F.col(id_col).alias("id"), _plain(F.col(text_col)).alias("text")).where("text is not null")
    count, chars = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    n = max(1, math.ceil(count / ITEMS), math.ceil((chars or 0) / CHARS))
    dealt = stage(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))) if n > 1 else None
    for b in range(n):
        rows = (items if dealt is None else dealt.where(F.col("block") == b)).select("id", "text").collect()
        rows.sort(key=lambda r: (r["id"] is None, str(r["id"]), r["text"]))
        yield Index([r["id"] for r in rows], [r["text"] for r in rows])


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, similarity, start, n_words, distance) of the best window of
    every document and item that match; ``start`` counts words.

    Words are runs of letters, marks and digits, lower-cased; a window has as
    many words as the item, and a shorter document is one window as a whole.
    Defined cases: null and empty texts and items match
    nothing; an item of fewer than five words is one shingle; ties go to the first window; repeated
    documents and repeated items each give their own rows; null ids are
    reported as null.  Other columns play no part.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), _plain(F.col(text_col)).alias("text"))
    item_type, id_type = dict(benchmark.dtypes)[item_col], dict(texts.dtypes)["id"]
    schema = f"id {id_type}, item {item_type}, similarity double, start long, n_words long, distance int"
    names = ["id", "item", "similarity", "start", "n_words", "distance"]
    found = None
    for index in _passes(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)  # bounded by ITEMS and CHARS

        def scan(batches, shared=shared):
            index = shared.value
            for batch in batches:
                rows, cols = [], ([], [], [], [], [])
                for row, n, match in index.scan(batch.column("text")):
                    for i, (value, start, distance) in sorted(match.items()):
                        rows.append(row)
                        for c, v in zip(cols, (index.ids[i], value, start, min(n, int(index.sizes[i])), distance)):
                            c.append(v)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(rows)), pa.array(cols[0]), pa.array(cols[1], pa.float64()),
                         pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())],
                        names=names)

        part = texts.mapInArrow(scan, schema)
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that match no item; equal rows share their fate, a null
    id is told apart by its text."""
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"))
                        .alias("key"), F.col(text_col).alias("text"))
    bad = matches(keyed, benchmark, "key", "text", item_col, item_text).select("id").distinct()
    rows = pack(docs).withColumn("th", F.xxhash64(F.coalesce(F.col(ROW)[text_col], F.lit(""))))
    clean = rows.join(bad, F.col(ROW)[id_col].eqNullSafe(F.col("id.id")) & (F.col("th") == F.col("id.th")), "left_anti")
    return unpack(clean, docs.columns)

"""Spelling variants by search schemes over bidirectional FM-indexes.

Two words that differ by one inserted, deleted or replaced code point are cut
in two halves by the length of the shorter one; the error lies in one half, so
the other is equal in both.  Every word is dealt to a shard by each of its
halves.  A shard indexes its words, delimited, in both directions; a search
holds the interval of its pattern among the sorted suffixes of the text and of
the reversed text, and can be extended at either end.  One scheme matches the
first half from the middle to its delimiter and then goes on to the right, the
other matches the second half and then goes on to the left, with exactly one
error until the other delimiter.  All searches of a shard advance together, and
searches in one interval share its extensions, so a step costs at most one pass
over the index however many words share a half.

Shards are bounded by characters; a half that is common to more words than a
shard holds is dealt to several, and its words search each of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage

#: Runs of these characters are words (a fixed value), of at least so many
#: code points and occurrences; one run in so many loses a code point.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, LOSS = 7, 2, 31
#: A word's form occurs at least so many times as often.
RATIO = 10
#: Characters that one shard indexes, and characters that search one part of a hot half.
INDEXED, SEARCHED = 1 << 17, 1 << 20
END, DELIMITER = 0, 1


# -- words -----------------------------------------------------------------------

def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts with their occurrences.

    Words are maximal runs of letters, A-Z in lower case.  Where ``LOSS``
    divides the crc32 h of ``<id>:<run>``, the run lacks its code point
    h % length.  Null texts have no words, a null id counts as empty."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Shorter runs cannot become words, so they are not taken out of the text.
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    h = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % LOSS == 0, less).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


# -- the index ---------------------------------------------------------------------

def _suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol is unique and smallest."""
    rank, k = text.astype(np.int64), 1
    while True:
        following = np.zeros(len(rank), np.int64)
        following[:-k] = rank[k:] + 1
        key = rank * (len(rank) + int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.empty(len(rank), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == len(rank) - 1:
            return order


class _Side:
    """One direction: the symbol before each sorted suffix, and for each symbol
    the sorted places where it stands."""

    def __init__(self, text: np.ndarray):
        self.suffixes = _suffixes(text)
        self.before = text[self.suffixes - 1]
        self.size = len(text)
        self.places = np.sort(self.before.astype(np.int64) * self.size + np.arange(self.size))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the suffixes begin that put ``symbol`` before those from ``at`` on."""
        return np.searchsorted(self.places, symbol * self.size + at)


class Index:
    """Bidirectional FM-index of delimited words, given as symbols from 2 on."""

    def __init__(self, words: list[np.ndarray]):
        body = np.concatenate([np.array([DELIMITER])] + [x for w in words for x in (w, np.array([DELIMITER]))])
        self.left = _Side(np.append(body, END))
        self.right = _Side(np.append(body[::-1], END))
        self._word = np.cumsum(body == DELIMITER) - 1

    def word_at(self, place: np.ndarray) -> np.ndarray:
        """The word whose delimiter begins the suffix at a place."""
        return self._word[self.left.suffixes[place]]

    def extensions(self, lo: np.ndarray, other: np.ndarray, size: np.ndarray, rightwards: bool):
        """All ways to extend intervals by one symbol in one direction: (interval,
        symbol, lo, other, size), ordered by interval and symbol.  ``lo`` counts
        among the suffixes of the text, ``other`` among those of the reversed text."""
        side, near, far = (self.right, other, lo) if rightwards else (self.left, lo, other)
        owner = np.repeat(np.arange(len(lo)), size)
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - begin[owner] + near[owner]
        key, count = np.unique(owner * (1 << 32) + side.before[place], return_counts=True)
        owner, symbol = key >> 32, key & 0xFFFFFFFF
        smaller = np.cumsum(count) - count
        moved_far = far[owner] + smaller - begin[owner]
        moved_near = side.step(symbol, near[owner])
        new = (moved_far, moved_near) if rightwards else (moved_near, moved_far)
        return key, owner, symbol, *new, count

    def extend(self, lo, other, size, rightwards):
        """As ``extensions`` for many searches: equal intervals are extended once.
        Returns each search's interval number and the table of extensions."""
        _, both = np.unique(lo * (self.left.size + 1) + other, return_inverse=True)
        _, first, number = np.unique(both * (self.left.size + 1) + size, return_index=True, return_inverse=True)
        return number, self.extensions(lo[first], other[first], size[first], rightwards)


def search(index: Index, text: np.ndarray, begin: np.ndarray, length: np.ndarray, shorter: np.ndarray,
           first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(search, word found): every word within exactly one error whose half is
    equal.  ``text`` holds the searched words, delimited; ``shorter`` is the
    length of the shorter word of the pairs sought: a search of that length
    replaces or inserts a symbol, one longer by one deletes one."""
    half = shorter // 2
    step = 1 if first_half else -1
    # The equal half, from the middle outwards to its delimiter.
    inner = begin + half - 1 if first_half else begin + length - (shorter - half)
    left = half + 1 if first_half else shorter - half + 1
    q = np.arange(len(begin))
    lo, other, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), index.left.size, np.int64)
    at, ready = inner.copy(), []
    while len(q):
        number, (key, _, _, los, others, sizes) = index.extend(lo, other, size, not first_half)
        k, hit = _find(key, number, text[at])
        q, lo, other, size, at = q[hit], los[k], others[k], sizes[k], at[hit] - step
        done = np.abs(at - inner[q]) == left[q]
        ready.append((q[done], lo[done], other[done], size[done]))
        q, lo, other, size, at = (x[~done] for x in (q, lo, other, size, at))
    q, lo, other, size = (np.concatenate(x) for x in zip(*ready)) if ready else (q, lo, other, size)
    # The other half, with exactly one error, to the other delimiter.
    at = inner[q] + step
    wrong = np.zeros(len(q), bool)
    found = []
    while len(q):
        # Of a run of equal symbols the last one is deleted.
        drop = ~wrong & (length[q] > shorter[q]) & (text[at] != DELIMITER)
        drop[drop] = text[at[drop]] != text[at[drop] + step]
        q, lo, other, size = (np.concatenate([x, x[drop]]) for x in (q, lo, other, size))
        at, wrong = np.concatenate([at, at[drop] + step]), np.concatenate([wrong, np.ones(int(drop.sum()), bool)])
        number, (key, owner, symbol, los, others, sizes) = index.extend(lo, other, size, first_half)
        k, hit = _find(key, number, text[at])
        over = text[at[hit]] == DELIMITER
        end = over & wrong[hit]
        found.append((q[hit][end], index.word_at(los[k[end]])))
        go, kg = hit[~over], k[~over]
        moved = [(q[go], los[kg], others[kg], sizes[kg], at[go] + step, wrong[go])]
        # Another symbol than the next: in its place, or before it (so that of a
        # run of equal symbols the inserted one is the last).
        may = np.flatnonzero(~wrong & (length[q] == shorter[q]))
        start, stop = np.searchsorted(owner, number[may]), np.searchsorted(owner, number[may], side="right")
        many = stop - start
        s = np.repeat(may, many)
        e = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        new = (symbol[e] != text[at[s]]) & (symbol[e] > DELIMITER)
        s, e = s[new], e[new]
        inside = text[at[s]] != DELIMITER
        for shift, take in ((step, inside), (0, np.ones(len(s), bool))):
            moved.append((q[s[take]], los[e[take]], others[e[take]], sizes[e[take]], at[s[take]] + shift, np.ones(int(take.sum()), bool)))
        q, lo, other, size, at, wrong = (np.concatenate(x) for x in zip(*moved))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, q)


def _find(key: np.ndarray, number: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extensions by a given symbol: (extension, search) where there is one."""
    want = number * (1 << 32) + symbol
    k = np.minimum(np.searchsorted(key, want), len(key) - 1)
    hit = np.flatnonzero(key[k] == want)
    return k[hit], hit


# -- shards --------------------------------------------------------------------------

def _shard(table: pa.Table) -> pa.Table:
    """Searches of one shard: per searching word and half, how many words are
    near and the most frequent of them."""
    held = table.group_by("word", use_threads=False).aggregate([("n", "max"), ("part_hash", "max"), ("indexed", "max")])
    words, n = held["word"].to_pylist(), held["n_max"].to_numpy()
    hashes = held["part_hash_max"].to_numpy()
    codes = [np.frombuffer(w.encode("utf-32-le"), "<u4") for w in words]
    alphabet = np.unique(np.concatenate(codes))
    symbols = [np.searchsorted(alphabet, c) + 2 for c in codes]
    indexed = np.flatnonzero(held["indexed_max"].to_numpy(zero_copy_only=False))
    text = np.concatenate([np.array([DELIMITER])] + [x for s in symbols for x in (s, np.array([DELIMITER]))])
    size = np.array([len(s) for s in symbols])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) + 1
    place = {w: i for i, w in enumerate(words)}
    asked = table.filter(pa.compute.field("searching"))
    who = np.array([place[w] for w in asked["word"].to_pylist()], np.int64)
    cols = {c: asked[c].to_numpy(zero_copy_only=False) for c in ("first_half", "shorter", "parts", "part")}
    out = []
    index = Index([symbols[i] for i in indexed]) if len(indexed) else None
    for first in (True, False):
        rows = np.flatnonzero(cols["first_half"] == first)
        if index is None or not len(rows):
            continue
        me, shorter = who[rows], cols["shorter"][rows].astype(np.int64)
        s, w = search(index, text, begin[me], size[me], shorter, first)
        w = indexed[w]
        # A pair belongs to the class of its shorter word and to the part of the word found.
        own = (np.minimum(size[me[s]], size[w]) == shorter[s]) & (hashes[w] % cols["parts"][rows][s] == cols["part"][rows][s])
        s, w = s[own], w[own]
        if not first:  # equal first halves are found by the other scheme
            own = np.array([words[a][:h] != words[b][:h] for a, b, h in zip(me[s], w, shorter[s] // 2)], bool)
            s, w = s[own], w[own]
        out.append((me[s], w))
    me, near = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2
    spelled = np.empty(len(words), np.int64)
    spelled[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((spelled[near], -n[near], me))
    me, near = me[order], near[order]
    begins = np.flatnonzero(np.diff(me, prepend=-1))
    counts = np.diff(np.append(begins, len(me)))
    return pa.table({"word": pa.array([words[i] for i in me[begins]], pa.string()), "near": pa.array(counts, pa.int64()),
                     "best_n": pa.array(n[near[begins]], pa.int64()), "best": pa.array([words[i] for i in near[begins]], pa.string())})


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, best, best_n) for every row of ``vocabulary`` (word, n),
    whose words are distinct: the number of other words within one error, and
    the most frequent of them (of equals the smallest in code-point order)."""
    vocabulary = stage(vocabulary.select("word", F.col("n").cast("long").alias("n")))
    length = F.length("word")
    # A word is the shorter one, or one of two of equal length, or longer by one.
    halves = vocabulary.withColumn("length", length).select("*", F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("shorter"))
    halves = halves.where("shorter >= 1").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("first_half"))
    half = F.expr("CASE WHEN first_half THEN substring(word, 1, shorter div 2) ELSE right(word, shorter - shorter div 2) END")
    dealt = stage(halves.select("word", "n", "length", "shorter", "first_half", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).alias("part_hash"),
                                F.xxhash64("shorter", "first_half", half).alias("key")))
    total = dealt.agg(F.sum(F.col("length") + 1)).first()[0] or 0
    shards = int(total // INDEXED) + 1
    hot = stage(dealt.groupBy("key").agg(F.sum(F.col("length") + 1).alias("chars")).where(F.col("chars") > INDEXED).select(
        "key", F.ceil(F.col("chars") / INDEXED).alias("parts"), F.ceil(F.col("chars") / SEARCHED).alias("askers")))
    rows = dealt.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("askers", F.coalesce("askers", F.lit(1)))
    mine, asks = F.col("part_hash") % F.col("parts"), F.floor(F.col("part_hash") / F.col("parts")) % F.col("askers")
    # Every part is searched by all words of its half, in groups of bounded size; each group gets the part's index words.
    rows = rows.withColumn("mine", mine).withColumn("asks", asks).select("*", F.explode(F.expr(
        "filter(flatten(transform(sequence(0L, parts - 1), p -> transform(sequence(0L, askers - 1), a -> "
        "named_struct('part', p, 'asker', a, 'indexed', p = mine, 'searching', a = asks)))), x -> x.indexed OR x.searching)")).alias("x"))
    rows = rows.select("word", "n", "part_hash", "shorter", "first_half", "parts", "x.part", "x.indexed", "x.searching",
                       F.pmod(F.xxhash64("key", "x.part", "x.asker"), F.lit(shards)).alias("shard"))
    # An explicit number of partitions: shards are few bytes but much work, so they are not to be coalesced.
    found = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(_shard, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``vocabulary``
    (word, n): the most frequent near word if it occurs at least ``ratio`` times
    as often, and the last word reached by following forms.  An empty
    vocabulary gives no rows; a word without near words is its own root."""
    real = F.col("best_n") >= ratio * F.col("n")
    known = stage(near_words(vocabulary).select("word", "n", "n_near", F.when(real, F.col("best")).alias("form"),
                                                F.when(real, F.col("best_n")).alias("form_n")))
    # Counts grow by the ratio along a chain, so it is short; each round doubles the way.
    way = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        way = stage(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if way.where("moved").isEmpty():
            break
        way = way.select("word", "root")
    return known.join(way.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

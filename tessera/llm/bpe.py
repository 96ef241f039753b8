"""Byte-level BPE encoding and decoding as a tree reduction.

Encoded texts form a monoid: the encoding of a whole follows from those of its
halves, as only tokens near the seam can differ.  It is used twice.

* A text is cut into matches of the pattern.  Halves are matched recursively;
  at a seam a window from the left half's first match that more text could
  change is matched again, and grows until a match in it that no more text can
  change begins where one of the right half does.  Matching looks back at
  nothing, so all after that place stands.
* A match is encoded by merging pairs.  Halves are encoded recursively; a
  window of tokens about the seam is re-encoded and grows until both its ends
  fit their neighbours.  Two tokens *fit* if their bytes encode to just these
  two.  A row of tokens in which all neighbours fit is the encoding of its
  bytes: merges within a token depend on no other token, so the first merge
  across a border of the row would also happen where only its two tokens are
  encoded.  The tokens outside the window are therefore final.

Every text is one row and its ids are hashed in order, so a row is encoded
within its task; nothing is shuffled and a lost task is run again by itself.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import text_buffer

#: The pattern whose matches are encoded (a fixed value): contractions, then runs
#: of letters, of numbers and of other characters, each with one space before
#: it, then white space, of which a run before other characters leaves its last.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text, and bytes of a match, that are encoded without a tree.
LEAF_CHARS, LEAF_BYTES = 1 << 16, 32
#: Contractions read so many characters at most; a run reads one beyond its end.
LOOK = 3
#: Bytes of texts that are encoded together, in arrays (a longer text is by itself).
SLICE = 1 << 21
#: Fitting pairs that a Python worker remembers.
REMEMBERED = 1 << 18
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_NONE = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
_HASH = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64)


#: Letters and numbers of Unicode 16 that Unicode 15 lacks (fixed values).  The
#: ranks' own library knows Unicode 16; what came later counts as other.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA)]


def classes() -> np.ndarray:
    """The kind of every code point: letter, number, white space or other."""
    kinds = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):  # without surrogates
        every = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                kinds[lo + m.start():lo + m.end()] = kind
    later = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    for lo, hi in UNICODE_16:
        later[lo:hi + 1] = False
    kinds[later] = _OTHER
    return kinds


def match_starts(codes: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the matches begin in texts of code points that stand end to end,
    each taken by itself; ``begins`` says where a text begins."""
    n = len(codes)
    kind = kinds[codes]
    first = np.zeros(n + 2, bool)
    first[begins] = True
    starts = first[:n].copy()
    starts[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # A run of white space before other characters leaves its last one, which
    # belongs to them if it is a space.
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    starts[last] = True
    starts[last[codes[last] == 0x20] + 1] = False
    quote = np.flatnonzero(starts[:-1] & (codes[:-1] == 0x27) & ~first[1:n])
    if len(quote):
        one, two = codes[quote + 1], np.append(codes, 0)[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for at, size in ((quote[short], 2), (quote[long & ~first[quote + 2]], 3)):
            starts[at + 1] = False
            after = at + size
            starts[after[after < n]] = True
    return np.flatnonzero(starts)


class Codec:
    """Ranks of a vocabulary, with the two reductions and decoding."""

    def __init__(self, table: bytes, kinds: np.ndarray):
        rows = [line.split() for line in table.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in rows}
        self.tokens = {r: t for t, r in self.ranks.items()}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.kinds = kinds
        self.fitting: dict[tuple[int, int], bool] = {}
        # Every pair of tokens that is a token, for merges of many matches at once.
        self.width = max(self.tokens) + 1
        pairs = sorted((self.ranks[t[:i]] * self.width + self.ranks[t[i:]], r) for t, r in self.ranks.items()
                       for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pairs, self.merged = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(1, np.int64) - 1,) * 2
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # The bytes of all tokens, end to end.
        sizes = np.zeros(self.width + 1, np.int64)
        sizes[[r + 1 for r in self.tokens]] = [len(t) for t in self.tokens.values()]
        self.offsets = np.cumsum(sizes)
        self.bytes = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)

    # -- one match: bytes to tokens ------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair
        is a token."""
        n, ranks = len(data), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[bytes | None] = [data[i:i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been merged since
            part[i] += part[j]
            part[j], k = None, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p in part if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens encode to these two."""
        found = self.fitting.get((a, b))
        if found is None:
            if len(self.fitting) >= REMEMBERED:
                self.fitting.clear()
            found = self.fitting[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        i, j = 1, 1
        while True:
            left, right = a[-i:], b[:j]
            mid = self.merge(b"".join(map(self.tokens.__getitem__, left + right)))
            begins = i >= len(a) or mid[0] == left[0] or self.fits(a[-i - 1], mid[0])
            ends = j >= len(b) or mid[-1] == right[-1] or self.fits(mid[-1], b[j])
            if begins and ends:
                return a[:-i] + mid + b[j:] if i < len(a) else mid + b[j:]
            i, j = i if begins else min(2 * i, len(a)), j if ends else min(2 * j, len(b))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def merge_many(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` for many matches, whose bytes stand end to end: their ids
        end to end, and how many each has.  Each round merges one pair of each."""
        ids = self.byte[data]
        own = np.repeat(np.arange(len(size)), size)
        rank = np.full(len(ids), _NONE)  # of each id and the next one of its match
        rank[:-1] = self._ranks(ids, own, np.arange(len(ids) - 1)) if len(ids) else rank[:0]
        ended = [(own[:0], ids[:0])]
        while len(ids):
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(ids)))
            done = np.repeat(least == _NONE, count)
            ended.append((own[done], ids[done]))
            best = np.flatnonzero((rank == np.repeat(least, count)) & (rank != _NONE))
            best = best[np.diff(own[best], prepend=-1) != 0]  # the leftmost
            keep = ~done
            keep[best + 1] = False
            ids[best] = rank[best]
            ids, own, rank = ids[keep], own[keep], rank[keep]
            # Only the pairs of the new tokens have changed.
            best = (np.cumsum(keep) - 1)[best]
            last = best == len(ids) - 1
            rank[best[last]] = _NONE
            changed = np.concatenate([best[~last], best[best > 0] - 1])
            rank[changed] = self._ranks(ids, own, changed)
        own, ids = (np.concatenate(x) for x in zip(*ended))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(size))

    def _ranks(self, ids: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at some places."""
        key = ids[at] * self.width + ids[at + 1]
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (own[at] == own[at + 1]), self.merged[k], _NONE)

    def encode_matches(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of matches, given by their places in ``data``, end to end, and
        how many each has.  Equal matches are encoded once."""
        if not len(begin):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_HASH[data] * power[:len(data)], out=total[1:])
        h = (total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
        _, first, number = np.unique(h, return_index=True, return_inverse=True)
        # A hash is not proof: matches that differ from the first of their hash are encoded apart.
        size = end - begin
        differ = size != size[first[number]]
        same = ~differ
        at, ref = _places(begin[same], size[same]), _places(begin[first[number[same]]], size[same])
        unequal = data[at] != data[ref]
        differ[np.flatnonzero(same)[np.repeat(np.arange(int(same.sum())), size[same])[unequal]]] = True
        number[differ] = len(first) + np.arange(int(differ.sum()))
        first = np.concatenate([first, np.flatnonzero(differ)])
        short = size[first] <= LEAF_BYTES
        begins, sizes = begin[first[short]], size[first[short]]
        ids, counts = self.merge_many(data[_places(begins, sizes)], sizes)
        trees = [np.array(self.tree(data[begin[k]:end[k]].tobytes()), np.int64) for k in first[~short]]
        count = np.empty(len(first), np.int64)
        count[short], count[~short] = counts, [len(t) for t in trees]
        ids = np.concatenate([ids, *trees])
        at = np.empty(len(first), np.int64)
        at[short], at[~short] = np.cumsum(counts) - counts, len(ids) - np.cumsum([len(t) for t in trees][::-1], dtype=np.int64)[::-1]
        return ids[_places(at[number], count[number])], count[number]

    # -- a text: characters to matches ---------------------------------------

    def joined(self, codes: np.ndarray, leaves: list[np.ndarray], lo: int, cuts: list[int]) -> np.ndarray:
        """Where the matches begin in a text from ``lo`` to ``cuts[-1]``, from
        those of its leaves, which end at ``cuts``, each taken by itself."""
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        mid, hi = cuts[half - 1], cuts[-1]
        left, right = self.joined(codes, leaves[:half], lo, cuts[:half]), self.joined(codes, leaves[half:], mid, cuts[half:])
        final = _final(left, mid)
        at, grown = int(left[final]), 2 * LOOK
        while True:
            end = min(mid + grown, hi)
            window = match_starts(codes[at:end], self.kinds, np.zeros(1, np.int64)) + at
            kept = window if end == hi else window[:_final(window, end) + 1]
            meet = np.intersect1d(kept, right)
            if len(meet) or end == hi:
                upto = meet[0] if len(meet) else hi
                return np.concatenate([left[:final], window[window < upto], right[right >= upto]])
            grown *= 2

    def starts(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the matches begin in texts that stand end to end; ``bounds``
        are their beginnings and the end of the last."""
        lengths = np.diff(bounds)
        n = np.maximum(-(-lengths // LEAF_CHARS), (lengths > 0).astype(np.int64))  # leaves of each text
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(text)) - (np.cumsum(n) - n)[text]
        cuts = np.append(bounds[:-1][text] + lengths[text] * k // np.maximum(n[text], 1), bounds[-1])
        found = match_starts(codes, self.kinds, cuts[:-1]) if len(codes) else cuts[:0]
        if (n <= 1).all():
            return found
        of = np.searchsorted(found, cuts)
        out, leaf = [], np.cumsum(n) - n
        for t in range(len(n)):
            i, j = int(leaf[t]), int(leaf[t] + n[t])
            parts = [found[of[x]:of[x + 1]] for x in range(i, j)]
            if parts:
                out.append(self.joined(codes, parts, int(cuts[i]), [*cuts[i + 1:j].tolist(), int(bounds[t + 1])]))
        return np.concatenate(out)

    def encode(self, column: pa.Array) -> pa.Array:
        """The ids of a text column, as little-endian unsigned 32-bit integers;
        null and empty texts have none."""
        off, data = text_buffer(column)
        parts, i = [], 0
        while i < len(column):
            j = min(max(int(np.searchsorted(off, off[i] + SLICE, side="right")) - 1, i + 1), len(column))
            cut = data[off[i]:off[j]]
            codes = np.frombuffer(cut.tobytes().decode().encode("utf-32-le"), "<u4")
            place = np.append(np.flatnonzero((cut & 0xC0) != 0x80), len(cut))  # of each code point
            bounds = np.searchsorted(place, off[i:j + 1] - off[i])
            starts = self.starts(codes, bounds)
            begin = place[starts]
            ids, count = self.encode_matches(cut, begin, np.append(begin[1:], len(cut)) if len(begin) else begin)
            tokens = np.append(0, np.cumsum(count))[np.searchsorted(starts, bounds)]
            parts.append(pa.Array.from_buffers(pa.large_binary(), j - i, [
                None, pa.py_buffer(4 * tokens), pa.py_buffer(ids.astype("<u4"))]))
            i = j
        return pa.concat_arrays(parts).cast(pa.binary()) if parts else pa.array([], pa.binary())

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > LEAF_CHARS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if len(ids) and int(ids.max()) >= self.width:
            raise ValueError("the vocabulary lacks an id")
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        if not size.all():
            raise ValueError("the vocabulary lacks an id")
        return self.bytes[_places(begin, size)].tobytes()


def _final(starts: np.ndarray, end: int) -> int:
    """How many of the matches up to ``end`` no text after it can change: those
    that end before it and begin ``LOOK`` characters before it at least."""
    return min(len(starts) - 1, int(np.searchsorted(starts, end - LOOK, side="right")))


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, end to end."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(max(n, SLICE + 1), b, np.uint64)
            t[0] = 1
            _POWERS.append(np.cumprod(t, dtype=np.uint64))
    return _POWERS


_LOADED: dict[bytes, Codec] = {}


class Vocabulary:
    """A rank file (base64 token and rank in each line, as tiktoken reads them).
    The driver reads it once and broadcasts it with the kinds of characters; it
    is as large as the vocabulary, whatever the data."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            table = f.read()
        kinds = classes()
        codec = Codec(table, kinds)
        for token, rank in codec.ranks.items():
            if codec.merge(token) != [rank]:
                raise ValueError(f"no merges lead to token {rank}")
        self._held = spark.sparkContext.broadcast((table, kinds.tobytes()))

    def codec(self) -> Codec:
        """This worker's codec, built once."""
        table, kinds = self._held.value
        if table not in _LOADED:
            _LOADED.clear()
            _LOADED[table] = Codec(table, np.frombuffer(kinds, np.uint8))
        return _LOADED[table]


def encode_text(vocabulary: Vocabulary, text: Column) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers (binary).
    Null and empty texts have no ids."""
    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return vocabulary.codec().encode(texts)
    return ids(text)


def decode_ids(vocabulary: Vocabulary, ids: Column) -> Column:
    """The bytes that ids stand for; null ids give no bytes.  An id that the
    vocabulary lacks is an error."""
    @F.arrow_udf("binary")
    def data(rows: pa.Array) -> pa.Array:
        codec = vocabulary.codec()
        return pa.array((codec.decode(np.frombuffer(r.as_py() or b"", "<u4").astype(np.int64)) for r in rows), pa.binary())
    return data(ids)


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """The input's columns plus ``ids`` (binary) and ``n_tokens``.

    Input columns of these names are replaced; rows are encoded one by one, so
    repeated rows and ids make no difference.  Null and empty texts have no
    tokens; a text or match of any length is encoded whole."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("ids", "n_tokens")]
    out = df.select(*kept, encode_text(vocabulary, F.col(f"`{text_col}`")).alias("ids"))
    return out.withColumn("n_tokens", F.expr("length(ids) div 4"))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """The input's columns plus ``decoded`` (binary), which replaces an input
    column of that name."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != "decoded"]
    return df.select(*kept, decode_ids(vocabulary, F.col(f"`{ids_col}`")).alias("decoded"))

"""Fuzzy passages that documents share, by collinear chaining.

1. Every text is sampled to k-mers of ``K`` words by winnowing: each run of
   ``K + WINNOW - 1`` words holds a seed, the same one wherever it stands.
2. A seed that several documents hold is matched between each of them and one
   of them, its hub, so a seed of n documents makes n - 1 matches.  As a hub
   may hold a piece of a passage only, the ``MIN_WORDS`` words from each seed on
   have a hub of their own, and so has each pair of near seeds of unequal hubs.
3. Per pair of documents the matches are chained: ordered in both texts, with
   a cost per skipped word, the best predecessor found by a tree of maxima.
4. Chains are aligned word by word: along their diagonals, through the gaps by
   edit distance, and outwards as long as the score grows.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import stage

K, WINNOW = 7, 4
MIN_WORDS = 50
MIN_IDENTITY = 0.8
GAP_COST = 0.25  # per word skipped in either text
MAX_GAP = 40  # words between neighbours of one chain, in either text
MISMATCH = 2.0  # what a differing word costs when an end is extended
MILDER = (MISMATCH, 1.0, 0.5)  # tried in turn until a span is long enough
REACH = 64  # words that an end is extended by, about
SKIP = 24  # words past which an extension looks for agreement again
_RUN = np.array([0x9E3779B97F4A7C15], np.uint64)


def seeds(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed k-mers of texts that lie one after the
    other in ``h``, text k from ``at[k]`` to ``at[k + 1]``."""
    g = W.combine(h, K)
    count = np.diff(at) - K + 1  # k-mers of each text
    taken = np.zeros(len(g), bool)
    for k in np.flatnonzero((count > 0) & (count < WINNOW)):
        taken[at[k] + g[at[k]:at[k] + count[k]].argmin()] = True
    windows = np.zeros(len(h) + 1, np.int64)
    long = count >= WINNOW
    windows[at[:-1][long]] = 1
    windows[at[:-1][long] + count[long] - WINNOW + 1] = -1
    begin = np.flatnonzero(np.cumsum(windows))
    low, least = begin.copy(), g[begin]
    for k in range(1, WINNOW):
        less = g[begin + k] < least
        low[less] = begin[less] + k
        least[less] = g[low[less]]
    taken[low] = True
    at = np.flatnonzero(taken)
    fresh = np.ones(len(at), bool)  # of a run of one repeated k-mer the first is enough
    fresh[1:] = (np.diff(at) > 1) | (g[at[1:]] != g[at[:-1]])
    at = at[fresh]
    return at, g[at]


def _runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, put together from runs of 1, 2, 4 ... words."""
    out, length = None, 0
    part, size = h, 1
    base = _RUN
    while k:
        if k & 1:
            n = len(h) - length - size + 1
            if n <= 0:
                return np.empty(0, np.uint64)
            # the run of the power of two follows the words so far
            out = part[:n].copy() if out is None else out[:n] * base + part[length:length + n]
            length += size
        k >>= 1
        if k:
            n = max(len(h) - 2 * size + 1, 0)
            part = part[:n] * base + part[size:size + n]
            size, base = 2 * size, base * base
    return W.mix(out)


_SEED = "rk long, h long, place long"


def _seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The seeds of each text; ``place`` is a seed's position and, in the lower
    half, a hash of the ``MIN_WORDS`` words from there on (0: there are fewer)."""
    for batch in batches:
        rk = batch.column("rk").to_numpy()
        for i, j, h, d, _, _ in W.words(batch.column("text")):
            begin = W.bounds(d, j - i)
            at, seed = seeds(h, begin)
            whole = at + MIN_WORDS <= len(h)
            whole[whole] = d[at[whole] + MIN_WORDS - 1] == d[at[whole]]
            wide = np.zeros(len(at), np.int64)
            wide[whole] = np.maximum(_runs_of(h, MIN_WORDS)[at[whole]] >> np.uint64(32), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rk[i:j][d[at]]), pa.array(seed.view(np.int64)), pa.array(at - begin[d[at]] << 32 | wide)],
                names=["rk", "h", "place"])


# What ``mark`` says of a seed: its first place in the document, once in each of its documents, two documents at all.
FIRST, ONCE, TWO = 1, 2, 4
_HELD = "h long, rk long, pos int, hub long, hpos int, wpos int, wide long, mark byte"


def _hubbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeds that several documents hold, with their hub; a seed's rows arrive
    together, by document and position, so those of its hub come first.

    ``hpos``: the first is matched with the hub's first, the second with its
    second, all further ones with its last.  ``wpos``: where the hub has the
    same ``MIN_WORDS`` words first, if it has but not at ``hpos``; ``wide`` is
    a hash of them if the hub has them nowhere and another document may.  Of a seed that goes on in the next
    batch only the rows of its hub and of its last document are held; it is
    marked as if it were repeated.
    """
    held = None
    for batch in batches:
        if not len(batch):
            continue
        rk, h, place = (batch.column(c).to_numpy() for c in ("rk", "h", "place"))
        done = np.zeros(len(h), bool)
        if held is not None:
            rk, h, place, done = (np.concatenate(c) for c in zip(held, (rk, h, place, done)))
        new = np.ones(len(h), bool)  # equal rows are of equal documents
        new[1:] = (h[1:] != h[:-1]) | (rk[1:] != rk[:-1]) | (place[1:] != place[:-1])
        rk, h, place, done = rk[new], h[new], place[new], done[new]
        begins = np.ones(len(h), bool)
        begins[1:] = h[1:] != h[:-1]
        opens = begins.copy()
        opens[1:] |= rk[1:] != rk[:-1]
        begin, opened = np.flatnonzero(begins), np.flatnonzero(opens)
        group, own = np.cumsum(begins) - 1, np.cumsum(opens) - 1
        turn = np.arange(len(h)) - opened[own]
        size = np.diff(np.append(opened, len(h)))[own[begin]]  # rows of the hub
        several = np.diff(np.append(begin, len(h))) > size
        last = begin[-1]
        keep = np.arange(len(h)) >= last
        if several[-1]:
            keep &= (own == own[last]) | (own == own[-1])
        out = several[group] & ~done
        held = [x[keep] for x in (rk, h, place, done | out)]
        if not out.any():
            continue
        is_hub = own == own[begin][group]
        pos, wide = place >> 32, place & 0xFFFFFFFF
        key = group << 32 | wide
        hubs = np.flatnonzero(is_hub & several[group] & (wide > 0))
        hubs = hubs[np.argsort(key[hubs], kind="stable")]
        take = np.flatnonzero(out)
        found = np.searchsorted(key[hubs], key[take])
        same = np.zeros(len(take), bool)
        there = found < len(hubs)
        same[there] = key[hubs[found[there]]] == key[take[there]]
        wpos = np.zeros(len(take), np.int64)
        wpos[same] = pos[hubs[found[same]]]
        g = group[take]
        at = begin[g] + np.minimum(turn[take], size[g] - 1)
        hpos = pos[at]
        same &= ~is_hub[take]
        whole = np.arange(len(begin)) < len(begin) - 1  # all rows of the seed are at hand
        whole[group[done]] = False
        holders = np.diff(np.append(np.searchsorted(opened, begin), len(opened)))
        once = whole & (np.diff(np.append(begin, len(h))) == holders)
        mark = FIRST * (turn[take] == 0) + ONCE * once[g] + TWO * (once & (holders == 2))[g]
        apart = np.flatnonzero((wide[take] > 0) & ~same & ~is_hub[take])
        apart = apart[np.argsort(key[take[apart]], kind="stable")]
        shared = ~whole[g[apart]]
        if len(apart):
            k, r = key[take[apart]], rk[take[apart]]
            one = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            end = np.append(one[1:], len(k))
            shared |= np.repeat(r[one] != r[end - 1], end - one)
        alone = np.ones(len(take), bool)
        alone[apart[shared]] = False
        both = W.mix(W.mix(~h[take].view(np.uint64)) + wide[take].view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[take]), pa.array(rk[take]), pa.array(pos[take].astype(np.int32)), pa.array(rk[begin[g]]),
             pa.array(hpos.astype(np.int32)), pa.array(wpos.astype(np.int32), mask=~same | (wide[at] == wide[take])),
             pa.array(both, mask=alone), pa.array(mark.astype(np.int8))],
            names=["h", "rk", "pos", "hub", "hpos", "wpos", "wide", "mark"])


_ASKED = "key long, asks boolean, named boolean, rk long, pos int, pos2 int, known long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the seeds of a document share besides their own hubs, under keys;
    a document's seeds arrive together, by position.

    - Every two seeds within ``MIN_WORDS`` words that have unequal hubs: their
      hub is the first document of that key.  Where each document holds both
      but once, a hub of one of them is ``known``: its matches are found by
      the seeds' own hubs and by the questions, and if only two documents hold
      one of them, there is no other hub.
    - A seed and another hub that a seed within ``MIN_WORDS`` words has (it
      follows the seed's own, or doesn't hold the seed): the row asks where
      that hub holds the seed first, the hub's own row answers.
    """
    def rows(key, asks, named, pos, pos2=None, known=None):
        n = len(key)
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(np.full(n, asks)), pa.array(np.full(n, named)),
             pa.array(np.full(n, rk)), pa.array(pos), pa.nulls(n, pa.int32()) if pos2 is None else pa.array(pos2),
             pa.nulls(n, pa.int64()) if known is None else known],
            names=["key", "asks", "named", "rk", "pos", "pos2", "known"])

    for rk, (h, pos, hub, mark) in _documents(batches, ("h", "pos", "hub", "mark")):
        h, mine = h.view(np.uint64), hub == rk
        if mine.any():
            at = (mark & FIRST > 0) & ~mine
            if at.any():
                yield rows(W.mix(W.mix(h[at]) ^ hub.dtype.type(rk).view(np.uint64)), False, True, pos[at])
        if (hub == hub[0]).all():
            continue
        for cut in range(0, len(pos), 1 << 16):
            at = np.arange(cut, min(cut + (1 << 16), len(pos)))
            count = np.searchsorted(pos, pos[at] + MIN_WORDS, side="right") - at - 1
            i = np.repeat(at, count)
            j = np.repeat(at + 1 - np.cumsum(count) + count, count) + np.arange(count.sum())
            differ = hub[i] != hub[j]
            i, j = i[differ], j[differ]
            if not len(i):
                continue
            once = mark[i] & mark[j] & ONCE > 0
            crossed = (pos[i] != pos[j]) & ~(once & ((mark[i] | mark[j]) & TWO > 0))
            a, b, once = i[crossed], j[crossed], once[crossed]
            if len(a):
                yield rows(W.mix(W.mix(h[a]) + h[b]), False, False, pos[a], pos[b],
                           pa.array(np.maximum(hub[a], hub[b]), mask=~once))
            i, j = np.where(hub[i] < hub[j], i, j), np.where(hub[i] < hub[j], j, i)
            theirs = ~mine[i] & ~mine[j]
            i, other = i[theirs], hub[j[theirs]]
            order = np.lexsort((other, i))
            i, other = i[order], other[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (other[1:] != other[:-1])
            i, other = i[new], other[new]
            if len(i):
                yield rows(W.mix(W.mix(h[i]) ^ other.view(np.uint64)), True, True, pos[i])


_MATCH = "rk long, hub long, pos int, hpos int"


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each key with its first row, but for known ones; a key's rows arrive
    together, answers before questions, by document and position."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        key, asks, named, rk, pos = (batch.column(c).to_numpy(zero_copy_only=False)
                                     for c in ("key", "asks", "named", "rk", "pos"))
        known = batch.column("known")
        known = known.is_valid().to_numpy(zero_copy_only=False), known.fill_null(0).to_numpy()
        cols = key, asks, rk, pos, batch.column("pos2").fill_null(-1).to_numpy(), named, *known
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols)]
        key, asks, rk, pos, pos2, named, has, known = cols
        begins = np.ones(len(key), bool)
        begins[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(begins)
        top = begin[np.cumsum(begins) - 1]
        held = [c[begin[-1]:begin[-1] + 1] for c in cols]
        out = np.flatnonzero((rk != rk[top]) & ~asks[top] & (asks == named) & ~(has & (known == rk[top])))
        two = out[pos2[out] >= 0]
        if len(out):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[out], x[two]])) for x in (rk, rk[top])]
                + [pa.array(np.concatenate([x[out], y[two]])) for x, y in ((pos, pos2), (pos[top], pos2[top]))],
                names=["rk", "hub", "pos", "hpos"])


def _documents(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """(rk, columns) of each document; its rows arrive together."""
    held: list[list[np.ndarray]] = []
    now = None
    for batch in batches:
        if not len(batch):
            continue
        rk = batch.column("rk").to_numpy()
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        cut = np.flatnonzero(np.diff(rk) != 0) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(rk)]):
            if held and rk[i] != now:
                yield now, [np.concatenate(c) for c in zip(*held)]
                held = []
            now = rk[i]
            held.append([c[i:j] for c in cols])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held)]


def runs(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Matches (x ascending) merged along their diagonals: rows (x, y, length)."""
    order = np.lexsort((x, x - y))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(x - y) != 0) | (np.diff(x) > K + WINNOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    out = np.stack([x[first], y[first], x[last] - x[first] + K], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chains(r: np.ndarray) -> list[np.ndarray]:
    """Best chains of the runs, each a list of row numbers; a run is in one
    chain at most.

    With the cost of a gap linear in the words skipped, the best predecessor
    of a run is the maximum of score + cost * (end in x + end in y) over the
    runs that end at most ``MAX_GAP`` words before it in both texts: runs enter
    and leave by their end in x and are asked for by a range of the ends in y.
    """
    if len(r) == 1:
        return [np.array([0])]
    n = len(r)
    begin_x, begin_y, size = r[:, 0].tolist(), r[:, 1].tolist(), r[:, 2].tolist()
    end_x, end_y = (r[:, 0] + r[:, 2]).tolist(), r[:, 1] + r[:, 2]
    ends = np.unique(end_y)
    leaf = (np.searchsorted(ends, end_y) + len(ends)).tolist()
    low = (np.searchsorted(ends, r[:, 1] - MAX_GAP) + len(ends)).tolist()
    high = (np.searchsorted(ends, r[:, 1], side="right") + len(ends)).tolist()
    end_y = end_y.tolist()
    none = (-np.inf, -1)
    tree = [none] * (2 * len(ends))
    held: dict[int, deque] = defaultdict(deque)  # per leaf, best first: runs that none later and better follows
    score, before = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: end_x[i])
    entered = left = 0

    def renew(at):
        tree[at] = held[at][0] if held[at] else none
        while at > 1:
            at >>= 1
            tree[at] = max(tree[2 * at], tree[2 * at + 1])

    for j in range(n):
        while entered < n and end_x[waiting[entered]] <= begin_x[j]:
            i = waiting[entered]
            entered += 1
            own = held[leaf[i]]
            value = (score[i] + GAP_COST * (end_x[i] + end_y[i]), i)
            while own and own[-1] <= value:
                own.pop()
            own.append(value)
            renew(leaf[i])
        while left < entered and end_x[waiting[left]] < begin_x[j] - MAX_GAP:
            i = waiting[left]
            left += 1
            if held[leaf[i]] and held[leaf[i]][0][1] == i:
                held[leaf[i]].popleft()
                renew(leaf[i])
        best, a, b = none, low[j], high[j]
        while a < b:
            if a & 1:
                best = max(best, tree[a])
                a += 1
            if b & 1:
                b -= 1
                best = max(best, tree[b])
            a >>= 1
            b >>= 1
        gain, i = best[0] - GAP_COST * (begin_x[j] + begin_y[j]), best[1]
        score[j] = size[j] + max(gain, 0.0)
        before[j] = i if gain > 0 else -1
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = before[j]
        if path:
            out.append(np.array(path[::-1]))
    return out


_CHAIN = "rk long, hub long, x array<int>, y array<int>, n array<int>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair (rk, hub); the matches of a pair arrive together."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def close(out):
        x, y = (np.concatenate(c) for c in zip(*held))
        held.clear()
        r = runs(x.astype(np.int64), y.astype(np.int64))
        for c in chains(r):
            a, b, size = r[c].T
            out.append((*now, a.tolist(), b.tolist(), size.tolist()))

    def table(out):
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                          names=["rk", "hub", "x", "y", "n"])

    for batch in batches:
        rk, hub, pos, at = (batch.column(c).to_numpy() for c in ("rk", "hub", "pos", "hpos"))
        out: list[tuple] = []
        cut = np.flatnonzero((np.diff(rk) != 0) | (np.diff(hub) != 0)) + 1
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(rk)]):
            if i == j:
                continue
            pair = (int(rk[i]), int(hub[i]))
            if now is not None and pair != now and held:
                close(out)
            now = pair
            held.append((pos[i:j], at[i:j]))
        if out:
            yield table(out)
    out = []
    if held:
        close(out)
    if out:
        yield table(out)


def _hashes(key: pa.Array, text: pa.Array) -> Iterator[np.ndarray]:
    """The hashed words of each row's text; rows of one key have one text."""
    key = key.to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    found = []
    for i, j, h, d, _, _ in W.words(text.filter(pa.array(new))):
        found += np.split((h >> np.uint64(32)).astype(np.uint32), W.bounds(d, j - i)[1:-1])
    return (found[k] for k in (np.cumsum(new) - 1).tolist())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hub's words that a chain needs, with their first position."""
    for batch in batches:
        first, part = [], []
        for h, y, n in zip(_hashes(batch.column("hub"), batch.column("hub_text")),
                           *(batch.column(c).to_pylist() for c in ("y", "n"))):
            a = max(0, y[0] - 2 * REACH)
            first.append(a)
            part.append(h[a:y[-1] + n[-1] + 2 * REACH].tobytes())
        keep = batch.select(["rk", "hub_id", "x", "y", "n"])
        yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(first, pa.int32()), pa.array(part, pa.binary())],
                                         names=[*keep.schema.names, "first", "part"])


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Word edit distance."""
    for _ in range(2):  # equal words at the begin and at the end cost nothing
        n = min(len(a), len(b))
        equal = a[:n] == b[:n]
        k = n if equal.all() else int(equal.argmin())
        a, b = a[k:][::-1], b[k:][::-1]
    if len(a) < 2 and len(b) < 2 or not len(a) or not len(b):
        return max(len(a), len(b))
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    # a column of the table at a time, as the bits of where its values go up and down (Myers 1999)
    every, top, total = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for w in b.tolist():
        equal = where.get(w, 0)
        flat = equal | down
        right = ((equal & up) + up ^ up) | equal
        more, less = down | every & ~(right | up), up & right
        total += (more & top > 0) - (less & top > 0)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | every & ~(flat | more), more & flat
    return total


def _straight(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[int, int]:
    """Words to go on along the diagonal for the best score, and how many of
    them differ."""
    n = min(len(a), len(b), REACH)
    if not n:
        return 0, 0
    equal = a[:n] == b[:n]
    total = np.cumsum(np.where(equal, 1.0, -cost))
    k = int(total.argmax())
    return (k + 1, int((~equal[:k + 1]).sum())) if total[k] > 0 else (0, 0)


def _extend(a: np.ndarray, b: np.ndarray, cost: float) -> tuple[int, int, int]:
    """Words to go on in a and in b, and the words that differ: along the
    diagonal, and past an insertion or deletion where three words in a row
    agree again within ``SKIP`` words and more is gained than the gap costs."""
    on, edits = _straight(a, b, cost)
    x = y = on
    while x < REACH and y < REACH:
        u, v = a[x:x + SKIP], b[y:y + SKIP]
        if len(u) < 3 or len(v) < 3:
            break
        same = u[:, None] == v[None, :]
        again = np.argwhere(same[:-2, :-2] & same[1:-1, 1:-1] & same[2:, 2:])
        if not len(again):
            break
        i, j = again[again.sum(axis=1).argmin()].tolist()
        lost = _edits(u[:i], v[:j])
        on, differ = _straight(a[x + i:], b[y + j:], cost)
        if on - differ - cost * (lost + differ) <= 0:
            break
        x, y, edits = x + i + on, y + j + on, edits + lost + differ
    return x, y, edits


def align(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], n: list[int],
          cost: float = MISMATCH) -> tuple[int, int, int, int, int]:
    """Spans in a and b, and the words that differ, of a chain of runs."""
    edits = sum(_inside(a, b, x, y, n)) + sum(_between(a, b, x, y, n))
    return _ends(a, b, x, y, n, edits, cost)


def _inside(a, b, x, y, n) -> list[int]:
    return [int((a[x[i]:x[i] + n[i]] != b[y[i]:y[i] + n[i]]).sum()) if n[i] > K else 0 for i in range(len(x))]


def _between(a, b, x, y, n) -> list[int]:
    return [_edits(a[x[i - 1] + n[i - 1]:x[i]], b[y[i - 1] + n[i - 1]:y[i]]) for i in range(1, len(x))]


def _ends(a, b, x, y, n, edits, cost) -> tuple[int, int, int, int, int]:
    left_x, left_y, d = _extend(a[max(0, x[0] - 2 * REACH):x[0]][::-1], b[max(0, y[0] - 2 * REACH):y[0]][::-1], cost)
    end_x, end_y = x[-1] + n[-1], y[-1] + n[-1]
    right_x, right_y, e = _extend(a[end_x:end_x + 2 * REACH], b[end_y:end_y + 2 * REACH], cost)
    return x[0] - left_x, end_x + right_x, y[0] - left_y, end_y + right_y, edits + d + e


def _alike(a: np.ndarray, b: np.ndarray, seen: np.ndarray) -> bool:
    """Whether two texts have word pairs enough in common for a passage: of
    ``MIN_WORDS`` words at least and with one differing word in four of them at
    most, each undoing two pairs.  ``seen`` has 2**16 marks, all unset."""
    u, v = ((x[:-1] * np.uint32(0x9E3779B1) + x[1:]) >> np.uint32(16) for x in (a, b))
    seen[v] = True
    both = int(seen[u].sum())
    seen[v] = False
    return both >= MIN_WORDS - 1 - 2 * int((1 / MIN_IDENTITY - 1) * MIN_WORDS + 0.5)


def spans(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], n: list[int]) -> list[tuple[int, int, int, int, int]]:
    """The passages of a chain: spans in a and b and the words that differ.  A
    chain that is no passage as a whole is parted at the gap that costs most."""
    out, todo = [], [(0, len(x))]
    inside, between = _inside(a, b, x, y, n), _between(a, b, x, y, n)
    while todo:
        i, j = todo.pop()
        edits = sum(inside[i:j]) + sum(between[i:j - 1])
        for cost in MILDER:
            span = _ends(a, b, x[i:j], y[i:j], n[i:j], edits, cost)
            s, e, rs, re, differ = span
            if min(e - s, re - rs) >= MIN_WORDS and differ <= (1 - MIN_IDENTITY) * max(e - s, re - rs):
                if not any(p[0] <= s and e <= p[1] and p[2] <= rs and re <= p[3] for p in out):
                    out.append(span)
                break
        else:
            if j - i > 1:
                k = i + 1 + int(np.argmax(between[i:j - 1]))
                todo += [(i, k), (k, j)]
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1 << 16, bool)
    for batch in batches:
        rows, cols = [], [[] for _ in range(5)]
        for r, (h, x, y, n, first, part) in enumerate(zip(
                _hashes(batch.column("rk"), batch.column("text")),
                *(batch.column(c).to_pylist() for c in ("x", "y", "n", "first", "part")))):
            b = np.frombuffer(part, np.uint32)
            if not _alike(h[max(0, x[0] - 2 * REACH):x[-1] + n[-1] + 2 * REACH], b, seen):
                continue
            for s, e, rs, re, edits in spans(h, b, x, [v - first for v in y], n):
                rows.append(r)
                for c, v in zip(cols, (s, e, rs + first, re + first, 1 - edits / max(e - s, re - rs))):
                    c.append(v)
        if rows:
            take = pa.array(rows)
            s, e, rs, re, same = (pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), s, e, batch.column("hub_id").take(take), rs, re, same],
                names=["id", "start", "end", "ref_id", "ref_start", "ref_end", "identity"])


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, ref_id, ref_start, ref_end, identity): passages of
    ``MIN_WORDS`` words or more that a document shares with another, its
    reference, at ``MIN_IDENTITY`` or more of equal words; positions count
    words, end exclusive.

    Words are runs without white space, A-Z lower-cased.  Of the documents that
    share a passage all but one are reported, against that one.  An exact run
    of ``MIN_WORDS + WINNOW - 1`` words in several documents is found whatever
    else they hold.  A passage with differing words is missed where it leaves no
    seed in common, or where each seed, and each near pair of seeds of unequal
    hubs, also stands, without the rest, in documents that come first by the
    hash of their rows.  Defined cases:
    null, empty and short texts share nothing; rows equal in id and text are
    one document; rows with one id and different texts, and null ids, are
    documents of their own; a passage repeated within one document only is not
    reported, and of one repeated within both the first places are matched with
    each other, the second ones, and so on, further ones with the last.  Other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.withColumn("rk", F.xxhash64("id", F.xxhash64("text"), F.length("text")))
    found = texts.select("rk", "text").mapInArrow(_seeded, _SEED)
    held = stage(found.repartition("h").sortWithinPartitions("h", "rk", "place").mapInArrow(_hubbed, _HELD))
    near = (held.select("rk", "hub", "h", "pos", "mark").repartition("rk").sortWithinPartitions("rk", "pos", "h")
            .mapInArrow(_near, _ASKED))
    no = F.lit(False)
    further = held.where("wide is not null").select("wide", no, no, "rk", "pos", F.lit(None).cast("int"),
                                                           F.lit(None).cast("long"))
    own = held.where("rk <> hub")
    matches = (own.select("rk", "hub", "pos", "hpos")
               .union(own.where("wpos is not null").select("rk", "hub", "pos", F.col("wpos").alias("hpos")))
               .union(near.union(further).repartition("key").sortWithinPartitions("key", "asks", "rk", "pos", "pos2")
                      .mapInArrow(_answered, _MATCH)))
    linked = stage(matches.repartition("rk").sortWithinPartitions("rk", "hub", "pos").mapInArrow(_chained, _CHAIN))
    once = texts.dropDuplicates(["rk"])
    hub = once.select(F.col("rk").alias("hub"), F.col("id").alias("hub_id"), F.col("text").alias("hub_text"))
    id_type = dict(texts.dtypes)["id"]
    cut = linked.join(hub, "hub").select("rk", "hub", "hub_id", "hub_text", "x", "y", "n").mapInArrow(
        _cut, f"rk long, hub_id {id_type}, x array<int>, y array<int>, n array<int>, first int, part binary")
    return cut.join(once, "rk").select("rk", "id", "text", "hub_id", "x", "y", "n", "first", "part").mapInArrow(
        _aligned, f"id {id_type}, start long, end long, ref_id {id_type}, ref_start long, ref_end long, "
                  "identity double")

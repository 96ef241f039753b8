"""Many literal patterns in one pass over a text.

The patterns form an Aho-Corasick automaton kept as arrays: next state by state
and character class, and per state the patterns that end there.  Texts of an
Arrow batch stand end to end and are cut into lanes of equal length that step
through the automaton together, each reading the end of the lane before it
first; so a character costs one table lookup whatever the number of patterns,
and overlapping matches are all found.

The plain expressions in ``functions.text`` scan a text once per pattern, which
is the better choice for a few of them.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import ColumnOrName, _c

#: Lanes that step together, and characters of the texts handled at once.
LANES, CHARS = 4096, 1 << 19
_BREAK = 0x110000  # stands between texts; no pattern holds it


class Automaton:
    """Next states and endings for distinct, non-empty patterns."""

    def __init__(self, patterns: list[str]):
        if not all(patterns) or len(set(patterns)) < len(patterns):
            raise ValueError("patterns must be distinct and not empty")
        self.patterns = patterns
        self.longest = max(map(len, patterns), default=1)
        chars = sorted({c for p in patterns for c in p})
        self.kind = np.zeros(_BREAK + 1, np.int32)  # 0: in no pattern
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        width = len(chars) + 1
        step: list[list[int]] = [[-1] * width]
        ends: list[list[int]] = [[]]
        for k, p in enumerate(patterns):
            s = 0
            for c in p:
                at = int(self.kind[ord(c)])
                if step[s][at] < 0:
                    step[s][at] = len(step)
                    step.append([-1] * width)
                    ends.append([])
                s = step[s][at]
            ends[s].append(k)
        fall = [0] * len(step)
        todo = deque()
        for at in range(width):
            if step[0][at] < 0:
                step[0][at] = 0
            else:
                todo.append(step[0][at])
        while todo:
            s = todo.popleft()
            ends[s] = ends[s] + ends[fall[s]]
            for at in range(width):
                to = step[s][at]
                if to < 0:
                    step[s][at] = step[fall[s]][at]
                else:
                    fall[to] = step[fall[s]][at]
                    todo.append(to)
        self.step = np.array(step, np.int32)
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.ends = np.array([k for e in ends for k in e], np.int64)
        self.says = np.diff(self.first) > 0
        self.size = np.array([len(p) for p in patterns], np.int64)
        # A pattern that can overlap itself is counted from match to match.
        self.overlaps = np.array([any(p.startswith(p[i:]) for i in range(1, len(p))) for p in patterns], bool)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end, pattern) of every match in an array of code points, by end."""
        n = len(codes)
        if not n or not self.patterns:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lead = self.longest - 1
        lanes = min(LANES, max(1, n // max(4 * lead, 64)))
        length = -(-n // lanes)
        kinds = np.zeros(lead + lanes * length, np.int32)
        kinds[lead:lead + n] = self.kind[codes]
        begin = np.arange(lanes) * length
        state = np.zeros(lanes, np.int32)
        at, who = [], []
        for i in range(lead + length):
            state = self.step[state, kinds[begin + i]]
            if i >= lead:
                hit = np.flatnonzero(self.says[state])
                if len(hit):
                    at.append(begin[hit] + (i - lead))
                    who.append(state[hit])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, state = np.concatenate(at), np.concatenate(who)
        many = self.first[state + 1] - self.first[state]
        end = np.repeat(place, many) + 1
        k = np.repeat(self.first[state] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        order = np.lexsort((self.ends[k], end))
        keep = order[end[order] <= n]
        return end[keep], self.ends[k][keep]


_WORDS: list[np.ndarray] = []


def _word_characters() -> np.ndarray:
    """Which code points are part of words, and the break, which is not."""
    if not _WORDS:
        table = np.zeros(_BREAK + 1, bool)
        for lo, hi in ((0, 0xD800), (0xE000, _BREAK)):
            for m in regex.finditer(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+", "".join(map(chr, range(lo, hi)))):
                table[lo + m.start():lo + m.end()] = True
        _WORDS.append(table)
    return _WORDS[0]


def _counts(automaton: Automaton, whole: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Texts x patterns: non-overlapping occurrences, of ``whole`` patterns
    those that stand as words."""
    out = np.zeros((len(texts), len(automaton.patterns)), np.int64)
    texts = pc.fill_null(texts, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        total = np.cumsum(sizes[i:] + 1)
        j = i + max(1, int(np.searchsorted(total, CHARS, side="right")))
        part = [t.encode("utf-32-le") for t in texts.slice(i, j - i).to_pylist()]
        gap = np.array([_BREAK], "<u4").tobytes()
        codes = np.frombuffer(gap + gap.join(part) + gap, "<u4")
        end, k = automaton.matches(codes)
        begins = np.concatenate([[1], 1 + np.cumsum(sizes[i:j] + 1)])[:-1]
        if whole.any():
            word = _word_characters()
            alone = ~whole[k] | (~word[codes[end - automaton.size[k] - 1]] & ~word[codes[end]])
            end, k = end[alone], k[alone]
        row = np.searchsorted(begins, end - 1, side="right") - 1
        again = automaton.overlaps[k]
        np.add.at(out, (row[~again] + i, k[~again]), 1)
        last: dict[int, int] = {}
        for e, p, r in zip(end[again].tolist(), k[again].tolist(), row[again].tolist()):
            if last.get(p, -1) <= e - automaton.size[p]:
                out[r + i, p] += 1
                last[p] = e
        i = j
    return out


def pattern_counts(text: ColumnOrName, patterns: list[str], whole_words: list[str] = ()) -> Column:
    """Occurrences of each pattern in the lower-cased text (array<int>, in the
    order of the distinct lower-cased ``patterns``), counted like Python's
    ``str.count``; those also in ``whole_words`` only where they stand as words.
    Null text holds none."""
    names = list(dict.fromkeys(p.lower() for p in patterns))
    whole = np.array([p in {w.lower() for w in whole_words} for p in names], bool)
    automaton = Automaton(names)

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        found = _counts(automaton, whole, texts)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(names), pa.array(found.ravel().astype(np.int32)))
    return count(F.lower(_c(text)))


def hits_once(text: ColumnOrName, stems: list[str], exact: list[str] = ()) -> Column:
    """Distinct stems found, as ``text.stem_hits`` counts them, in one pass."""
    return F.size(F.filter(pattern_counts(text, stems, exact), lambda n: n > 0))


def occurrences_once(text: ColumnOrName, keywords: list[str]) -> Column:
    """Sum of occurrences, as ``text.keyword_occurrences`` counts them, in one
    pass; a keyword listed twice counts twice."""
    lowered = [k.lower() for k in keywords]
    names = list(dict.fromkeys(lowered))
    times = F.array(*[F.lit(lowered.count(n)) for n in names])
    return F.aggregate(F.zip_with(pattern_counts(text, keywords), times, lambda n, t: n * t), F.lit(0), lambda a, n: a + n)

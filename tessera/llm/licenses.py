"""License notices by conditional compression.

Blocks of lines with license words are compressed alone and with each template
as raw zstandard dictionary.  A template is confirmed on a window of words about
its own size, by how much it shrinks the window and by the exact differences in
wording, so nothing depends on what stands around the notice; where none is
confirmed, the templates are ranked by how much they shrink the block.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 6
MIN_GAIN = 0.2  # share of the window's size that a template must save
MIN_COVER = 0.8  # share of the template's words that the window must hold
#: Lines this far apart still belong to one block.
NEAR = 2

# Notices in common use, as their publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to "
        "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal."],
}
_SOURCE = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
           "disclaimer. ")
_BINARY = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
           "following disclaimer in the documentation and/or other materials provided with the distribution. ")
_NAMES = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
          "products derived from this software without specific prior written permission. ")
_BSD = TEMPLATES["BSD-3-Clause"][1] + ": "
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
for _one, _two, _three in (("", "", ""), ("1. ", "2. ", "3. ")):
    _both = _BSD + _one + _SOURCE + _two + _BINARY
    TEMPLATES["BSD-2-Clause"].append(_both + _AS_IS)
    TEMPLATES["BSD-3-Clause"].append(_both + _three + _NAMES + _AS_IS)
for _name, _wordings in TEMPLATES.items():
    _wordings.append(f"SPDX-License-Identifier: {_name}")
#: Words that tell licenses apart: none of them may be missing or added.
DECISIVE = frozenset("""mit apache gnu gpl lgpl agpl lesser affero mozilla mpl bsd isc creative commons cc cc0 by nc sa
nd noncommercial sharealike noderivatives unencumbered clause not neither""".split())

TRIGGER = r"(?i)licen[cs]e|permission|redistribut|warrant|public domain|spdx|\bcc0\b"
_LINE = re.compile(TRIGGER + r"|copyright|software|liab|conditions|copies|merchantab|damages")
_START = re.compile(TRIGGER)
_SPDX = re.compile(r"(?i)(spdx-license-identifier:)([^\n]*)")
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _tags(block: str) -> str:
    """SPDX expressions as one tag for each license."""
    return _SPDX.sub(lambda m: " ".join(f"{m[1]} {x}" for x in re.split(r"(?i)\s(?:or|and)\s|[()]", m[2]) if x.strip()), block)


def _size(data: bytes, dictionary: bytes = b"") -> int:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return len(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False).compress(data))


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(first line, line after, text) of runs of lines with license words, at
    least one of which names a license, a permission or the like."""
    out: list[list] = []
    for i, line in enumerate(text.split("\n")):
        if _LINE.search(line):
            if out and i - out[-1][1] < NEAR:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
    lines = text.split("\n") if out else []
    found = [(a, b, "\n".join(lines[a:b])) for a, b in out]
    return [x for x in found if _START.search(x[2])]


class Scanner:
    """Templates with their compressors ready."""

    def __init__(self, templates: dict[str, list[str]] | None = None):
        self.templates = [(name, words_of(t)) for name, ts in (templates or TEMPLATES).items() for t in ts]
        self.counts = [Counter(w) for _, w in self.templates]
        self.coders = [zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
            " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in self.templates]

    def ranked(self, own: list[str]) -> list[tuple[float, int]]:
        """(share saved, template), from the template that saves most."""
        data = " ".join(own).encode()
        alone = _size(data)
        gains = [(1 - len(c.compress(data)) / alone, -i) for i, c in enumerate(self.coders)]
        return [(g, -i) for g, i in sorted(gains, reverse=True)]

    def differences(self, own: list[str], template: int) -> tuple[float, list[str], list[str], int, int]:
        """Share of the template's words in the words given, words missing,
        words added between the first and last match, and where these are."""
        name, want = self.templates[template]
        match = SequenceMatcher(None, want, own, autojunk=False)
        ops = [o for o in match.get_opcodes()]
        while ops and ops[0][0] == "insert":
            ops.pop(0)
        while ops and ops[-1][0] == "insert":
            ops.pop()
        missing = [w for tag, a, b, _, _ in ops if tag in ("delete", "replace") for w in want[a:b]]
        added = [w for tag, _, _, a, b in ops if tag in ("insert", "replace") for w in own[a:b]]
        first, last = (ops[0][3], ops[-1][4]) if ops else (0, 0)
        return 1 - len(missing) / len(want), missing, added, first, last

    def windows(self, own: list[str], template: int):
        """Starts and ends of the windows that may hold the template: from one
        of the words it can begin with, with words enough of it."""
        want = self.templates[template][1]
        least = MIN_COVER * len(want)
        words, heads = set(want), set(want[:int(len(want) - least + 1e-9) + 1])
        size = len(want) + max(8, len(want) // 2)
        total = np.concatenate([[0], np.cumsum([w in words for w in own])])
        start = np.flatnonzero([w in heads for w in own])
        end = np.minimum(start + size, len(own))
        fits = total[end] - total[start] >= least - 1e-9
        return zip(start[fits].tolist(), end[fits].tolist())

    def confirmed(self, own: list[str]) -> list[tuple]:
        """(first word, word after, template, gain, cover, missing, added) of
        the confirmed templates, in order; of those that overlap the one with
        more of its words, then the longer one."""
        have, found = Counter(own), []
        for t, (_, want) in enumerate(self.templates):
            if sum(min(n, have[w]) for w, n in self.counts[t].items()) < MIN_COVER * len(want) - 1e-9:
                continue
            done = 0
            for a, b in self.windows(own, t):
                if a < done:
                    continue
                cover, missing, added, first, last = self.differences(own[a:b], t)
                if cover < MIN_COVER or any(w in DECISIVE or w[0].isdigit() for w in missing + added):
                    continue
                data = " ".join(own[a + first:a + last]).encode()
                gain = 1 - len(self.coders[t].compress(data)) / _size(data)
                if gain >= MIN_GAIN:
                    found.append((a + first, a + last, t, gain, cover, missing, added))
                    if cover == 1:
                        done = a + last
        out: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[4], -len(self.templates[x[2]][1]), -x[3], x[2], x[0])):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in out):
                out.append(x)
        return sorted(out)

    def scan(self, text: str):
        """(first line, line after, license, gain, cover, missing, added,
        confirmed) per candidate block and confirmed notice in it; where none
        is confirmed, of the license that saves most."""
        for a, b, block in blocks(text):
            own = words_of(_tags(block))
            if not own:
                continue
            found = [(t, gain, cover, missing, added) for _, _, t, gain, cover, missing, added in self.confirmed(own)]
            sure = bool(found)
            if not sure:
                gain, t = self.ranked(own)[0]
                found = [(t, gain, *self.differences(own, t)[:3])]
            for t, gain, cover, missing, added in found:
                yield a, b, self.templates[t][0], gain, cover, " ".join(missing), " ".join(added), sure


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, first_line, after_line, license, gain, cover, missing, added,
    confirmed): one row for each confirmed notice of a candidate block, with the
    block's lines, and one for a block that has none.  Notices do not overlap.

    ``templates`` maps license names to wordings and is bounded by its use as a
    parameter.  Defined cases: null and empty texts have no blocks; lines are
    the pieces between ``\\n``; of equal candidates the first template wins;
    repeated rows are scanned each on its own; null ids are reported as null.
    Other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(TRIGGER))
    id_type = dict(texts.dtypes)["id"]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
    names = ["first_line", "after_line", "license", "gain", "cover", "missing", "added", "confirmed"]

    def scan(batches):
        scanner = Scanner(templates)
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                for hit in scanner.scan(text):
                    rows.append(r)
                    found.append(hit)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), *[pa.array(c, t) for c, t in zip(zip(*found), kinds)]],
                    names=["id", *names])

    return texts.mapInArrow(scan, f"id {id_type}, first_line int, after_line int, license string, gain double, "
                                  "cover double, missing string, added string, confirmed boolean")

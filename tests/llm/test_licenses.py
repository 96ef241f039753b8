from tessera.llm.licenses import scan_licenses


def _got(df):
    return sorted((str(r.id), r.license, r.confirmed, r.first_line, r.after_line) for r in scan_licenses(df).collect())


def test_notices(docs):
    mit = ("Copyright 2020 foo\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software "
           "and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including "
           "without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
           "copies of the Software")
    rows = [(1, "intro\n" + mit + "\nend"), (2, "text\nLicensed under CC BY-NC 4.0.\nmore"),
            (3, "This work is licensed under the GNU General Public License, version 3."),
            (4, "This work is licensed under the GNU General Public License, version 2."),
            (5, "Licensed under the Apache License, Version 2.0."), (6, "no license here"), (7, "nothing at all"),
            (8, "Licensed under CC BY-SA 4.0.\n\n\n\nReleased under the MIT License.")]
    assert _got(docs(rows)) == [
        ("1", "MIT", True, 1, 7), ("2", "CC-BY-NC-4.0", True, 1, 2), ("3", "GPL-3.0", True, 0, 1),
        ("4", "GPL-2.0", True, 0, 1), ("5", "Apache-2.0", True, 0, 1), ("6", _license(docs, rows, 6), False, 0, 1),
        ("8", "CC-BY-SA-4.0", True, 0, 1), ("8", "MIT", True, 4, 5)]


def _license(docs, rows, k):
    return scan_licenses(docs([r for r in rows if r[0] == k])).first().license


def test_decisive_words(docs):
    rows = [(1, "Licensed under the Apache License, Version 3.0."), (2, "Licensed under CC BY-NC-SA 4.0.")]
    assert not any(r.confirmed for r in scan_licenses(docs(rows)).collect())


def test_edges(docs):
    line = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (4, "pad\n" * 50_000 + line), (5, "license\n" * 2000)]
    got = _got(docs(rows))
    assert [g for g in got if g[2]] == [("3", "MIT", True, 0, 1), ("3", "MIT", True, 0, 1), ("4", "MIT", True, 50_000, 50_001),
                                        ("None", "MIT", True, 0, 1)]
    assert _got(docs(rows).limit(0)) == []


BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
       "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
       "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
       "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
       "with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
       "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS "
       "FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
NAMES = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
         "products derived from this software without specific prior written permission. ")


def test_surroundings_do_not_matter(docs):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(1, f"{words} Released under the MIT License. {words}"), (2, f"{words} SPDX-License-Identifier: MIT {words}"),
            (3, BSD.format("")), (4, BSD.format(NAMES)), (5, "// SPDX-License-Identifier: LGPL-3.0-only"),
            (6, f"{words} the license of {words}")]
    assert [g[:3] for g in _got(docs(rows)) if g[2]] == [
        ("1", "MIT", True), ("2", "MIT", True), ("3", "BSD-2-Clause", True), ("4", "BSD-3-Clause", True),
        ("5", "LGPL-3.0", True)]


def test_every_notice_of_a_block(docs):
    rows = [(1, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."),
            (2, "Released under the MIT License. Released under the MIT License. Licensed under CC BY 4.0."),
            (3, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"),
            (4, "Licensed under CC BY-NC-SA 4.0.\nReleased under the ISC License.")]
    assert [(g[0], g[1]) for g in _got(docs(rows)) if g[2]] == [
        ("1", "Apache-2.0"), ("1", "MIT"), ("2", "CC-BY-4.0"), ("2", "MIT"), ("2", "MIT"),
        ("3", "Apache-2.0"), ("3", "BSD-3-Clause"), ("3", "MIT"), ("4", "ISC")]
    assert all(g[2] for g in _got(docs(rows)))

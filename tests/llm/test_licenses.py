"""Licence scans: against DuckDB, wrapped headers and whole files, and inheritance on small trees."""

import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from trackframe.llm import licenses
from trackframe.llm.queries import ORACLES, op5_license_scans


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    df = op5_license_scans(spark, sf)
    assert same(df, ORACLES["op5_license_scans"], sf) == 1000
    found = {r.licence for r in df.where("origin = 'statement'").collect()}
    assert {"Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0"} <= found


def test_statements_and_nearest_ancestor(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "LICENSE", mit, 0), (2, "a/b/c.py", "code", 0), (3, "a/LICENSE.txt", apache + "\nmore words\n", 0), (4, "a/b/d/e.py", None, 0), (5, "x/y.py", "", 0),
        (6, "a/z.py", "some code\n# This work is licensed under the GNU General Public License, version 3.\ncode", 0), (7, None, "code", 0), (8, "ab/c.py", "a driving license is not free", 0),
        (9, "a/b/d/only.md", "Licensed under CC BY-NC 4.0", 0), (9, "a/b/d/only.md", "Licensed under CC BY-NC 4.0", 0), (None, "a/b/q.py", "x", 0), (10, "/abs/f.py", "x", 0),
    ]
    frame = spark.createDataFrame(files, "id long, path string, text string, licence int")
    rows = licenses.scan(frame, "id", F.col("path")).collect()
    got = sorted(((str(r.id), r.licence, r.origin, r.licence_directory) for r in rows), key=str)
    want = [
        ("1", "MIT", "statement", None), ("2", "Apache-2.0", "inherited", "a"), ("3", "Apache-2.0", "statement", None), ("4", "CC-BY-NC-4.0", "inherited", "a/b/d"), ("5", "MIT", "inherited", ""),
        ("6", "GPL-3.0", "statement", None), ("7", None, "none", None), ("8", "MIT", "inherited", ""), ("9", "CC-BY-NC-4.0", "statement", None), ("9", "CC-BY-NC-4.0", "statement", None),
        ("None", "Apache-2.0", "inherited", "a"), ("10", "MIT", "inherited", ""),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(frame.limit(0), "id", F.col("path")).count() == 0


GPL2 = """/*
 * main.c - does a thing
 *
 * Copyright (C) 2001 Some Body
 *
 * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY.
 */
int main(void) { return 0; }
"""
GPL3 = GPL2.replace("software; you", "software: you").replace("Foundation; either version 2", "Foundation, either version 3")
LGPL = GPL2.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
APACHE = """
                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.
"""


def wrapped(text, width=70, mark=""):
    lines, line = [], mark
    for word in text.split():
        if len(line) + len(word) > width:
            lines.append(line)
            line = mark
        line += " " + word
    return "\n".join([*lines, line])


def whole(licence):
    return max((t for name, t in licenses.TEMPLATES if name == licence), key=len)


CASES = [
    ("a/main.c", GPL2, "GPL-2.0"), ("a/main3.c", GPL3, "GPL-3.0"), ("a/lib.c", LGPL, "LGPL-2.1"), ("b/LICENSE", APACHE, "Apache-2.0"), ("b/x.py", "print(1)", "Apache-2.0"),
    ("c/LICENSE", "Copyright (c) 2020, A B\nAll rights reserved.\n\n" + wrapped(whole("BSD-3-Clause")), "BSD-3-Clause"), ("d/LICENSE", "Copyright (c) 2020, A B\n\n" + wrapped(whole("BSD-2-Clause")), "BSD-2-Clause"),
    ("e/f.go", "// Copyright 2019 X. All rights reserved.\n// Licensed under the MIT License.\npackage e\n", "MIT"), ("e/g.go", "// Copyright 2019 X. All rights reserved.\npackage e\n", "proprietary"),
    ("f/mit.py", wrapped("Copyright (c) 2020 A B " + whole("MIT"), mark="#") + "\n\nimport os\n" + "x = 1\n" * 400, "MIT"), ("g/one.txt", "word " * 30 + "end. Released under the MIT License. " + "more words " * 20, "MIT"),
    ("h/bsd.c", "/*\n" + wrapped(whole("BSD-3-Clause"), mark=" *") + "\n */\n" + "int x;\n" * 50, "BSD-3-Clause"), ("i/driving.md", "a driving license is not free of charge", None), ("j/long.txt", "license " * 30_000, None),
    ("k/html.html", "<!-- SPDX-License-Identifier: GPL-3.0-only -->\n<p>x</p>", "GPL-3.0"),
]


def test_headers_and_files_as_wholes(spark):
    files = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(CASES)], "id long, path string, text string")
    got = {r.id: r.licence for r in licenses.scan(files, "id", F.col("path")).collect()}
    assert [(CASES[i][0], got[i]) for i in sorted(got)] == [(p, want) for p, _, want in CASES]


@pytest.mark.parametrize("similarity", [0.5, 0.7, 0.9])
def test_no_unit_without_a_cue_reaches_the_threshold(similarity):
    rnd = random.Random(1)
    for n in (0, 10, 10_000):
        df = {w: rnd.randint(0, n) for w in licenses.VOCABULARY}
        _, vectors = licenses.weigh(n, df)
        cue = set(licenses.cues(vectors, similarity))
        # the best that a unit without cues can reach with a template
        assert all(sum(x * x for w, x in v.items() if w not in cue) ** 0.5 < similarity for v in vectors)
        assert len(cue) < len(licenses.VOCABULARY)


def test_denied_licences_and_long_files(spark):
    """What denies a licence states none and gives none to its neighbours; long licence files are known by their sentences."""
    preamble = "The GNU General Public License is a free, copyleft license for software and other kinds of works. "
    boost = "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted to anyone.\n" + "and more of it " * 2_000
    files = [
        ("a/readme.txt", "This is not released under the MIT License", None), ("a/b.py", "x", None), ("b/x.md", "It isn't licensed under the Apache License, Version 2.0.", None), ("c/y.md", "Never licensed under the MIT License", None),
        ("d/COPYING", preamble * 40, "GPL-3.0"), ("d/z.c", "int x;", "GPL-3.0"), ("e/LICENSE", wrapped(whole("Zlib")), "Zlib"), ("e/q.c", "int x;", "Zlib"), ("f/LICENSE", boost, "BSL-1.0"),
        ("g/LICENSE", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS\n" + "of this and that " * 3_000, "EPL-2.0"), ("h/LICENSE", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0\n\n1. Definitions.\n", "CDDL-1.0"),
        ("i/main.c", GPL2.replace("ANY WARRANTY.", "ANY WARRANTY. If not, see the site."), "GPL-2.0"), ("j/bsd.c", wrapped(whole("BSD-3-Clause"), mark="#"), "BSD-3-Clause"),
    ]
    frame = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(files)], "id long, path string, text string")
    got = {r.id: r.licence for r in licenses.scan(frame, "id", F.col("path")).collect()}
    assert [(files[i][0], got[i]) for i in sorted(got)] == [(p, want) for p, _, want in files]

"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

A file is looked at in units: all of its text, its header (the comment lines it
begins with), its blocks (lines between blank ones, joined, so wrapped statements
are whole again), its sentences and its lines; comment marks are taken off first. A
unit counts up to twice the words of the longest template; what is longer is seen by
its parts. Equal units are compared once, however many files hold them.

Words are weighed by term frequency and by inverse document frequency over all
files; a word that no template has weighs like the rarest one that some template
has. So the weights of all templates fit a small table, and the sparse cosine of
every unit with every template is a join on the words with it.

Only units that hold a word of ``cues`` are compared, which loses none: those words
are chosen from the weights so that a unit without any of them stays below the
threshold with every template (what is left of a template's unit vector is shorter
than it).

A unit with more words of denial than a template does not count for it: "not released under the MIT License" states nothing.
A file takes the licence of its best unit; a mere reservation of rights (``FALLBACK``)
counts only where nothing else is found. A file without a licence takes that of the
nearest directory above it that holds a licence file: one with a licence's name, or
one whose whole text is a licence. Directories are compared once, however many files
they hold.

Column expressions, joins and aggregations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.llm.common import join_unique, let, materialize

WORD = "[a-z0-9]+"
SIMILARITY = 0.7
LICENCE_NAME = r"(?i)\A(licen[sc]e|copying|unlicense|notice)([-._].*)?\z"
#: What marks a line as a comment, at its beginning and its end.
COMMENT = "^[ \\t]*(?://+|/\\*+|\\*+/?|#+|--+|;+|%+|<!--|\"\"\"|''')"
COMMENT_END = "[ \\t]*(?:\\*+/|-->|\"\"\"|''')?[ \\t]*$"
SENTENCE_END = r"""([.!?]["')]*)[ \t]+"""
FALLBACK = "proprietary"
#: A unit that has more of these words than a template denies what the template states.
NEGATIONS = ("aren", "cannot", "isn", "neither", "never", "no", "nor", "not", "wasn")

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_NO_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
    "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
    "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)


_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to "
    "anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
    "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)


def _gnu(name: str, version: str, thing: str, pause: str) -> str:
    return (
        f"This {thing} is free software{pause} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, "
        "or (at your option) any later version."
    )


# The sentences, notices, titles and short whole texts by which files name their licence.
TEMPLATES = (
    ("AGPL-3.0", _gnu("Affero General Public License", "3", "program", ":")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT + _WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", _gnu("General Public License", "2", "program", ";")),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", _gnu("General Public License", "3", "program", ":")),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library", ";")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "library", ":")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", _ZLIB),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("Zlib", "Licensed under the zlib License"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("CDDL-1.0", "COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution License"),
    ("CDDL-1.0", "SPDX-License-Identifier: CDDL-1.0"),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    (FALLBACK, "Copyright. All rights reserved"),
    (FALLBACK, "All rights reserved"),
)


def _split(text: str) -> list[str]:
    """The words of a template, as ``words_of`` finds them."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def denials(words: list[str]) -> int:
    return sum(w in NEGATIONS for w in words)


VOCABULARY = tuple(sorted({w for _, text in TEMPLATES for w in _split(text)}))
#: Longer units are looked at by their parts.
LONGEST = 2 * max(len(_split(text)) for _, text in TEMPLATES)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def document_frequencies(text: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of files, and in how many each word of ``VOCABULARY`` is (so many rows at most)."""
    known = text.select(F.array_intersect(words_of(F.col("text")), _strings(VOCABULARY)).alias("words"))
    # one row for all files, and one for each word
    rows = known.select(F.explode(F.concat(F.array(F.lit("")), "words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def weigh(n: int, df: dict[str, int]) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The idf of every word of ``VOCABULARY``, and the unit vector of every template."""
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}
    vectors = []
    for _, text in TEMPLATES:
        own = _split(text)
        raw = {w: own.count(w) * idf[w] for w in sorted(set(own))}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append({w: x / norm for w, x in raw.items()})
    return idf, vectors


def cues(vectors: list[dict[str, float]], similarity: float) -> list[str]:
    """Words of which every unit has one that reaches ``similarity`` with some template."""
    chosen: set[str] = set()
    for vector in vectors:
        rest = sum(x * x for w, x in vector.items() if w not in chosen)
        for w, x in sorted(vector.items(), key=lambda wx: (-wx[1], wx[0])):
            if rest < similarity * similarity - 1e-4:
                break
            if w not in chosen:
                chosen.add(w)
                rest -= x * x
    return sorted(chosen)


def units(text: Column, cue: list[str]) -> Column:
    """(whole, units) of a text: its words, and the distinct word sequences of its units that hold a cue, space-joined."""
    fits = lambda ws: F.size(ws).between(1, LONGEST) & F.arrays_overlap(ws, _strings(cue))
    spelled = lambda ws: F.array_join(ws, " ")
    lines = F.split(text, r"\r?\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, COMMENT + "?[ \\t]*", ""), COMMENT_END, ""))
    code = F.transform(lines, lambda x: ~F.rlike(x, F.lit(COMMENT)) & ~F.rlike(x, F.lit("^[ \\t]*$")))

    def cut(v: Column) -> Column:
        first = F.array_position(v["code"], True)  # 0: comments all over
        header = F.array_join(F.slice(v["bare"], F.lit(1), F.when(first == 0, F.size(v["bare"])).otherwise(first - 1).cast("int")), " ")
        joined = F.array_join(v["bare"], "\n")
        blocks = F.transform(F.split(joined, r"\n\n+"), lambda b: F.replace(b, F.lit("\n"), F.lit(" ")))
        sentences = lambda bs: F.flatten(F.transform(bs, lambda b: F.split(F.regexp_replace(b, SENTENCE_END, "$1\n"), "\n")))
        parts = let(blocks, lambda bs: F.concat(F.array(joined, header), bs, sentences(bs), v["bare"]))
        found = F.transform(F.filter(F.transform(parts, words_of), fits), spelled)
        return F.struct(spelled(words_of(joined)).alias("whole"), F.array_distinct(found).alias("units"))

    return let(F.struct(bare.alias("bare"), code.alias("code")), cut)


def files_with_units(files: DataFrame, id_col: str, path: Column, text_col: str, cue: list[str]) -> DataFrame:
    """(row, id, directory, named, units of (key, words, is_whole)) of every file; texts go no further."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    has = F.arrays_overlap(words_of(text), _strings(cue))
    keyed = lambda v: F.transform(v["units"], lambda u: F.struct(F.sha2(u, 256).alias("key"), u.alias("words"), (u == v["whole"]).alias("is_whole")))
    none = F.array().cast("array<struct<key:string,words:string,is_whole:boolean>>")
    name = F.regexp_extract(path, "[^/]*$", 0)
    return files.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        F.regexp_replace(path, "/?[^/]*$", "").alias("directory"),
        F.coalesce(F.rlike(name, F.lit(LICENCE_NAME)), F.lit(False)).alias("named"),
        F.when(has, let(units(text, cue), keyed)).otherwise(none).alias("units"),
    )


def cosines(distinct: DataFrame, idf: dict[str, float], vectors: list[dict[str, float]], similarity: float = SIMILARITY) -> DataFrame:
    """(key, licence, fallback, cosine, n) of the best template of each distinct unit (key, words, n) that reaches ``similarity``.

    Of equal cosines the first template wins; ``FALLBACK`` gives way to any other.
    """
    spark = distinct.sparkSession
    weights = spark.createDataFrame([(i, TEMPLATES[i][0], w, x, idf[w]) for i, v in enumerate(vectors) for w, x in v.items()], "template int, licence string, word string, v double, idf double")
    nots = F.size(F.filter(F.split("words", " "), lambda w: w.isin(*NEGATIONS))).alias("nots")
    counted = distinct.select("key", "n", nots, F.explode(F.split("words", " ")).alias("word")).groupBy("key", "n", "nots", "word").agg(F.count("*").alias("tf"))
    known = F.broadcast(weights.groupBy("word").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("template", "licence", "v")).alias("of")))
    rows = counted.join(known, "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(max(idf.values()))))
    # a row for the norm, and one for each template that has the word
    rows = rows.select("key", "n", "nots", "w", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("licence"), F.col("w").alias("v"))), F.coalesce("of", F.array().cast("array<struct<template:int,licence:string,v:double>>")))).alias("t"))
    dots = rows.groupBy("key", "n", "nots", "t.template", "t.licence").agg(F.sum(F.col("w") * F.col("t.v")).alias("dot"))
    one = F.struct((F.col("licence") != FALLBACK).alias("specific"), "dot", (-F.col("template")).alias("first"), "licence")
    norm = F.sqrt(F.max(F.when(F.col("template") < 0, F.col("dot"))))
    allowed = F.array(*(F.lit(denials(_split(text))) for _, text in TEMPLATES))
    reach = F.filter(F.col("all"), lambda x: (F.round(x["dot"] / F.col("norm"), 6) >= similarity) & (F.element_at(allowed, 1 - x["first"]) >= F.col("nots")))
    rounded = F.transform(reach, lambda x: F.struct(x["specific"].alias("specific"), F.round(x["dot"] / F.col("norm"), 6).alias("cosine"), x["first"].alias("first"), x["licence"].alias("licence")))
    best = dots.groupBy("key", "n", "nots").agg(norm.alias("norm"), F.collect_list(F.when(F.col("template") >= 0, one)).alias("all"))  # as many as there are templates at most
    best = best.select("key", "n", F.array_max(rounded).alias("best")).where("best is not null")
    return best.select("key", "best.licence", "best.specific", "best.cosine", "n")


def _best(prefix: str = "") -> Column:
    """The best of many (licence, specific, cosine): specific before not, then cosine, then the smallest name."""
    ranks = sorted({name for name, _ in TEMPLATES}, reverse=True)
    rank = F.array_position(_strings(ranks), F.col(f"{prefix}licence"))
    return F.max(F.struct(F.col(f"{prefix}specific").alias("specific"), F.col(f"{prefix}cosine").alias("cosine"), rank.alias("rank"), F.col(f"{prefix}licence").alias("licence")))


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, licence, origin, cosine, licence_directory, n_statements) of every file.

    ``origin`` is ``statement``, ``inherited`` or ``none``; ``n_statements`` counts
    the distinct units that reach the threshold and deny nothing. Of equal cosines the smallest
    licence name wins. Null and empty texts have no units; a null path has no
    directory and inherits nothing; repeated rows stay; an empty table gives no
    rows. Other columns of ``files`` are ignored.
    """
    n, df = document_frequencies(files.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    idf, vectors = weigh(n, df)
    rows = materialize(files_with_units(files, id_col, path, text_col, cues(vectors, similarity)), "licences")
    said = rows.select("row", F.explode("units").alias("u")).select("row", "u.*")
    distinct = said.groupBy("key").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    found = materialize(cosines(distinct, idf, vectors, similarity), "statements")
    own = join_unique(said.select("row", "key", "is_whole"), found, "key").groupBy("row").agg(_best().alias("best"), F.bool_or("is_whole").alias("whole"), F.count("*").alias("n_statements"))
    rows = rows.select("row", "id", "directory", "named").join(own, "row", "left")
    rows = materialize(rows.select("id", "directory", (F.col("named") | F.coalesce("whole", F.lit(False))).alias("is_licence"), "best", F.coalesce("n_statements", F.lit(0)).cast("long").alias("n_statements")), "stated")

    inside = rows.where("directory is not null")
    holders = inside.where("is_licence and best is not null").groupBy("directory").agg(_best("best.").alias("given")).withColumnRenamed("directory", "above")
    directories = inside.groupBy("directory").agg(F.count("*").alias("n"))
    named = directories.join(nearest(directories.select("directory"), holders), "directory", "left")
    nothing = dict(named.dtypes)["given"]
    rows = join_unique(inside, materialize(named, "directories"), "directory").unionByName(
        rows.where("directory is null").withColumn("above", F.lit(None).cast("string")).withColumn("given", F.lit(None).cast(nothing))
    )
    stated, given = F.col("best").isNotNull(), F.col("given").isNotNull()
    return rows.select(
        "id",
        F.coalesce("best.licence", "given.licence").alias("licence"),
        F.when(stated, "statement").when(given, "inherited").otherwise("none").alias("origin"),
        F.coalesce("best.cosine", "given.cosine").alias("cosine"),
        F.when(~stated & given, F.col("above")).alias("licence_directory"),
        "n_statements",
    )


def nearest(directories: DataFrame, holders: DataFrame) -> DataFrame:
    """(directory, above, given): the nearest holder at or above each directory; both sides distinct."""
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    pairs = directories.select("directory", F.explode(above).alias("a")).select("directory", "a.*")
    hit = pairs.join(holders, "above").groupBy("directory").agg(F.max_by(F.struct("above", "given"), "depth").alias("best"))
    return hit.select("directory", "best.*")

"""License scans: TF-IDF cosine of header lines to templates, then nearest-ancestor directory inheritance."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Notices by which works declare a license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license with three clauses.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, all copyright is waived under the CC0 Universal dedication.",
}
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
#: Headers and texts over several lines. Each is compared with as many words of a document, from a place on where its
#: first two words stand. Of the GNU, Apache and Mozilla licence files the titles stand for the long texts.
HEADERS = {
    "MIT": ["MIT License", "The MIT License", _MIT + _AS_IS, _MIT],
    "ISC": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "BSD-2-Clause": ["BSD 2-Clause License", _BSD + _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License", _BSD + _BSD_THIRD + _BSD_END],
    "Apache-2.0": ["Apache License Version 2.0, January 2004", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "GPL-2.0": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _GNU.format("General Public License", 2)],
    "GPL-3.0": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("General Public License", 3)],
    "LGPL-3.0": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _GNU.format("Lesser General Public License", 3)],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _GNU.format("Affero General Public License", 3)],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
#: Titles of fewer words count only as a line of their own.
TITLE = 4
#: An SPDX line names one licence or an expression of several.
SPDX = r"SPDX-License-Identifier:\s*((?:\(\s*)*[A-Za-z0-9.+-]+(?:\s*\))*(?:\s+(?:AND|OR|WITH)\s+(?:\(\s*)*[A-Za-z0-9.+-]+(?:\s*\))*)*)"
#: Names that an SPDX line may hold, without a version's -only, -or-later or +; then exceptions to licences
KNOWN = """0BSD AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause
BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPAL-1.0 CPL-1.0
ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FTL GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL
MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0 UPL-1.0 Unlicense Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
EXCEPTIONS = "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 Font-exception-2.0 GCC-exception-3.1 Linux-syscall-note LLVM-exception OpenSSL-exception".split()
SPLIT = r"[^\p{L}\p{N}]+"
THRESHOLD = 0.75
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _windows(rows: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """(__id, __path, __k, line, t, key): the words from each place on where the header ``key`` begins, as many as it has.

    A header begins where its first two words stand one after the other, wherever in a line, and goes over as many
    lines as it needs. ``line`` is that of its first word. Titles of few words count as a line of their own only.
    """
    texts = {f"{k}#{i}": _words(h) for k, v in headers.items() for i, h in enumerate(v)}
    begins = sorted({tuple(w[:2]) for w in texts.values()})
    starts = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(rf"{a}[^\p{{L}}\p{{N}}]+{b}" for a, b in begins) + r")(?![\p{L}\p{N}])"
    # few texts have such a place; only those are cut
    some = rows.filter(F.col("__text").rlike(starts)).select("__id", "__path", "__k", F.transform(F.split("__text", "\n"), _terms).alias("lines"))
    words = F.flatten(F.transform("lines", lambda ws, k: F.transform(ws, lambda w: F.struct(w.alias("w"), k.alias("line")))))
    some = some.withColumn("all", words).filter(F.size("all") >= 2).withColumn("words", F.col("all.w"))
    at = some.select("__id", "__path", "__k", "lines", "all", "words", F.explode(F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array(F.element_at("words", i), F.element_at("words", i + 1)).isin([F.array(F.lit(a), F.lit(b)) for a, b in begins]))).alias("i"))
    at = at.withColumn("line", F.element_at("all", F.col("i"))["line"]).withColumn("one", F.element_at("words", F.col("i"))).withColumn("two", F.element_at("words", F.col("i") + 1))

    def fits(key: str, w: list[str]) -> Column:
        same = (F.col("one") == w[0]) & (F.col("two") == w[1])
        if len(w) < TITLE:
            same = same & (F.element_at("lines", F.col("line") + 1) == F.array(*map(F.lit, w)))
        return F.when(same, F.struct(F.lit(key).alias("key"), F.array_join(F.slice("words", F.col("i"), F.lit(len(w))), " ").alias("t")))

    hits = F.filter(F.array(*[fits(k, w) for k, w in sorted(texts.items())]), lambda x: x.isNotNull())
    return at.select("__id", "__path", "__k", "line", F.explode(hits).alias("h")).select("__id", "__path", "__k", "line", "h.t", "h.key")


def spdx_name(line: Column) -> Column:
    """The licence, or the expression of licences, that an SPDX line names, as SPDX writes it; null if some name is not known."""
    usual = F.create_map(*[F.lit(x) for k in (*KNOWN, *EXCEPTIONS) for x in (k.lower(), k)])
    tokens = F.regexp_extract_all(F.regexp_extract(line, SPDX, 1), F.lit(r"[A-Za-z0-9.+-]+|[()]"), F.lit(0))

    def named(x: Column) -> Column:
        base = F.regexp_replace(F.lower(x), r"(-only|-or-later|\+)$", "")
        suffix = F.lower(F.regexp_extract(x, r"(?i)(-only|-or-later|\+)$", 1))
        return F.when(x.isin("AND", "OR", "WITH", "(", ")"), x).otherwise(F.concat(F.element_at(usual, base), suffix))

    made = F.transform(tokens, named)
    text = F.regexp_replace(F.regexp_replace(F.array_join(made, " "), r"\( ", "("), r" \)", ")")
    text = F.regexp_replace(text, r"^\(([^()]*)\)$", "$1")
    level = lambda c: F.size(F.filter(tokens, lambda x: x == c))
    return F.when((F.size(tokens) > 0) & F.forall(made, lambda x: x.isNotNull()) & (level("(") == level(")")), text)


def scan(
    df: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    share: float = 0.5,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    headers: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(id, path, license, score, line, inherited, inherited_from) for each row.

    ``license``: the template that the best line of the whole text comes closest to, with a cosine (``score``) of
    ``threshold`` or more; ties go to the smaller template name, then the earlier ``line``. Term weights are counts
    times ln(1 + N / df) over all texts. ``headers`` (default: ``HEADERS``) are compared with windows over several
    lines, so that headers and whole licence files count too; an SPDX line of known names gives its licence, or its
    expression of several, a score of 1. A row is a licence file if its name says so or the lines that match hold
    ``share`` of its words. ``inherited``: for rows without a license of their own, that of the licence file in the
    nearest directory at or above theirs (the best score there, then the smaller path); ``inherited_from`` is its path.

    Null or empty texts have no license of their own; a null path has no directory and inherits nothing. Repeated rows
    get the same result each and count once as a file; rows that share an id and a path but not the text are judged
    apart. A text of any length is scanned whole, line by line. Of the input only id, path and text are read, so that
    other columns may have any name. An empty table gives an empty one.

    Plan: one pass counts in how many texts each word is, pre-aggregated before its shuffle. Lines are then filtered by
    a bound that no line of ``threshold`` can miss: by Cauchy's inequality, the terms shared with a template hold at
    least the square of ``threshold`` of its squared weight. Only words of such lines are joined with their counts.
    Directories are resolved as distinct paths; rows then join their directory by equality.
    """
    if headers is None:
        headers = HEADERS if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    rows = df.select(F.col(id_col).alias("__id"), F.col(path_col).alias("__path"), F.col(text_col).cast("string").alias("__text"))
    # rows that repeat an id and a path are told apart by their text
    rows = rows.withColumn("__k", F.xxhash64("__text"))
    spread = rows.select(F.explode(F.array_distinct(_terms(F.col("__text")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    spread = common.checkpoint(spread)
    total = rows.count()
    words = {k: _words(v) for k, v in templates.items()}
    known = sorted({w for v in words.values() for w in v})
    words |= {f"{k}#{i}": _words(h) for k, v in headers.items() for i, h in enumerate(v)}
    every = sorted({w for v in words.values() for w in v})
    df_of = {r["w"]: r["df"] for r in spread.filter(F.col("w").isin(every)).collect()}
    idf = {w: math.log(1 + total / max(1, df_of.get(w, 0))) for w in every}
    vectors = {k: {w: v.count(w) * idf[w] for w in v} for k, v in words.items()}
    norms = {k: math.sqrt(sum(x * x for x in v.values())) or 1.0 for k, v in vectors.items()}

    # candidate lines: shared squared weight of some template reaches threshold^2 of its whole
    def lines_of(some: DataFrame) -> DataFrame:
        return some.filter(F.col("__text").isNotNull()).select("__id", "__path", "__k", F.posexplode(F.split("__text", "\n")).alias("line", "t"))

    lines = lines_of(rows)
    shared = F.array_intersect(F.array_distinct(_terms(F.col("t"))), F.array(*map(F.lit, known)))
    lines = lines.withColumn("shared", shared).filter(F.size("shared") > 0)

    def reaches(name: str) -> Column:
        part = sum((F.when(F.array_contains("shared", w), x * x / norms[name] ** 2).otherwise(0.0) for w, x in sorted(vectors[name].items())), F.lit(0.0))
        return part >= threshold**2 - 1e-9

    any_reach = F.lit(False)
    for name in sorted(templates):
        any_reach = any_reach | reaches(name)
    near = lines.filter(any_reach).select("__id", "__path", "__k", "line", "t", F.lit(None).cast("string").alias("key"))
    if headers:
        near = near.unionByName(_windows(rows, headers))
    # repeated rows count once
    near = common.checkpoint(near.distinct())
    # a line is weighed once for each different text; repeated lines and rows share the result
    texts = near.select("t").distinct()
    tf = texts.select("t", F.explode(_terms(F.col("t"))).alias("w")).groupBy("t", "w").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    weights = spark.createDataFrame([(k, w, x / norms[k]) for k, v in vectors.items() for w, x in v.items()], "name string, w string, x double")
    weighed = tf.join(spread, "w").withColumn("y", F.col("n") * F.log1p(F.lit(float(total)) / F.col("df")))
    length = weighed.groupBy("t").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"), F.sum("n").alias("words"))
    # the templates are a few literal rows
    dots = weighed.join(F.broadcast(weights), "w").groupBy("t", "name").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cos = dots.join(length, "t").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= threshold)
    # a line answers to the one-line templates, a window to the header that it was cut for
    near = near.select("__id", "__path", "__k", "line", "t", F.coalesce("key", F.lit("")).alias("key"))
    cos = cos.withColumn("key", F.when(F.col("name").contains("#"), F.col("name")).otherwise("")).withColumn("name", F.substring_index("name", "#", 1))
    best = cos.groupBy("t", "key").agg(F.min(F.struct((-F.col("score")).alias("s"), "name", "words")).alias("b")).select("t", "key", (-F.col("b.s")).alias("score"), F.col("b.name").alias("name"), F.col("b.words").alias("words"))
    found = near.join(best, ["t", "key"]).select("__id", "__path", "__k", "line", "score", "name", "words", "key")
    if headers:
        spdx = lines_of(rows.filter(F.col("__text").contains("SPDX-License-Identifier"))).withColumn("name", spdx_name(F.col("t"))).filter("name IS NOT NULL")
        found = found.unionByName(spdx.select("__id", "__path", "__k", "line", F.lit(1.0).alias("score"), "name", F.size(_terms(F.col("t"))).cast("long").alias("words"), F.lit("").alias("key")).distinct())
    # windows may overlap each other and lines, so that only the longest counts
    told = [F.sum(F.when(F.col("key") == "", F.col("words")).otherwise(0)), F.max(F.when(F.col("key") != "", F.col("words")).otherwise(0))]
    hits = found.groupBy("__id", "__path", "__k").agg(F.min(F.struct((-F.col("score")).alias("s"), "name", "line")).alias("b"), F.greatest(*told).alias("hit_words"))
    hits = hits.select(F.col("__id").alias("h_id"), F.col("__path").alias("h_path"), F.col("__k").alias("h_k"), F.col("b.name").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.line").alias("line"), "hit_words")
    sized = rows.select("__id", "__path", "__k", F.size(_terms(F.coalesce("__text", F.lit("")))).alias("n_words"))
    direct = sized.join(hits, F.col("__id").eqNullSafe(F.col("h_id")) & F.col("__path").eqNullSafe(F.col("h_path")) & (F.col("__k") == F.col("h_k")), "left").drop("h_id", "h_path", "h_k")
    direct = direct.withColumn("dir", F.when(F.col("__path").contains("/"), F.regexp_replace("__path", r"/[^/]*$", "")).when(F.col("__path").isNotNull(), ""))
    direct = common.checkpoint(direct)

    files = direct.filter(F.col("license").isNotNull() & (F.col("__path").rlike(LICENCE_FILE) | (F.col("hit_words") >= share * F.col("n_words"))))
    places = files.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "__path", "license")).alias("b"))
    places = places.select(F.col("dir").alias("up"), F.col("b.license").alias("inherited"), F.col("b.__path").alias("inherited_from"))
    dirs = direct.filter("dir IS NOT NULL").select("dir").distinct()
    steps = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(steps))).alias("depth")).withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/"))
    nearest = ancestors.join(places, "up").groupBy("dir").agg(F.max(F.struct("depth", "inherited", "inherited_from")).alias("b")).select("dir", "b.inherited", "b.inherited_from")
    out = direct.join(nearest, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__path").alias(path_col),
        "license",
        "score",
        "line",
        F.when(~own, F.col("inherited")).alias("inherited"),
        F.when(~own, F.col("inherited_from")).alias("inherited_from"),
    )

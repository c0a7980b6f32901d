"""License scans: CC BY-NC notices, headers over several lines, whole licence files and SPDX lines."""

import random
import textwrap

from pyspark.sql import functions as F

from emberlog.llm import license_scan as ls

SCHEMA = "doc_id long, path string, text string"


def wrapped(name, i, before="", width=70):
    return before + "\n".join(textwrap.wrap(ls.HEADERS[name][i], width))


def test_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    want = {r.doc_id for r in docs.filter(F.col("text").contains("Licensed under CC BY-NC 4.0.")).collect()}
    got = {r.doc_id for r in ls.scan(docs).filter("license = 'CC-BY-NC-4.0'").collect()}
    assert want and want == got


def test_headers_files_and_spdx(spark):
    code = "\nimport os\n" + "value = other word\n" * 30
    gpl = "\n".join("# " + x for x in textwrap.wrap(ls.HEADERS["GPL-3.0"][1], 60))
    rows = [
        (1, "m/LICENSE", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + wrapped("MIT", 2)),
        (2, "m/src/a.txt", "plain words"),
        (3, "g/a.py", "#!/usr/bin/env python\n# Copyright 2020\n" + gpl + code),
        (4, "g/b.py", "# SPDX-License-Identifier: Zlib" + code),
        (5, "b3", wrapped("BSD-3-Clause", 1)),
        (6, "b2", wrapped("BSD-2-Clause", 1)),
        (7, "COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n" + code),
        (8, "n", "this program is free for all who like it" + code),
        (9, "ap", "/*\n * " + wrapped("Apache-2.0", 1).replace("\n", "\n * ") + "\n */" + code),
    ]
    got = {r.doc_id: r for r in ls.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i].license for i in (1, 3, 4, 5, 6, 7, 9)} == {1: "MIT", 3: "GPL-3.0", 4: "Zlib", 5: "BSD-3-Clause", 6: "BSD-2-Clause", 7: "GPL-2.0", 9: "Apache-2.0"}
    assert got[8].license is None and got[3].line == 2
    assert got[2].inherited == "MIT" and got[2].inherited_from == "m/LICENSE" and got[8].inherited == "GPL-2.0"


def test_probes_of_places_and_expressions(spark):
    mit = ls.HEADERS["MIT"][2]
    cases = {
        1: mit.replace(" ", "\n"),  # one word a line
        2: "Copyright 2020 Jo. " + mit,  # not at the beginning of its line
        3: "text before\n\n" + "// Copyright (c) Jo. All of it: " + mit[:300] + "\n// " + mit[300:] + "\nand after",
        4: "# SPDX-License-Identifier: (MIT OR Apache-2.0)\ncode",
        5: "SPDX-License-Identifier: Banana",
        6: "/* SPDX-License-Identifier: gpl-2.0-only WITH Linux-syscall-note */",
        7: "SPDX-License-Identifier: MIT AND (Apache-2.0+ OR Banana)",
        8: "say permission is given, nothing more",
        9: "the mit license is short",  # a title within a line
        10: "  MIT License  ",
    }
    df = spark.createDataFrame([(i, f"d{i}/x.c", t) for i, t in cases.items()], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.line) for r in ls.scan(df).collect()}
    assert got[1] == ("MIT", 0) and got[2] == ("MIT", 0) and got[3] == ("MIT", 2)
    assert got[4] == ("MIT OR Apache-2.0", 0) and got[5][0] is None and got[6][0] == "GPL-2.0-only WITH Linux-syscall-note"
    assert got[7][0] is None and got[8][0] is None and got[9][0] is None and got[10][0] == "MIT"


def test_windows_against_brute_force(spark):
    rng = random.Random(9)
    headers = {"A": ["alpha beta gamma delta epsilon"], "B": ["alpha beta one two three four"], "T": ["tiny title"]}
    bits = ["alpha", "beta", "gamma", "delta", "epsilon", "one", "two", "three", "tiny", "title", "x"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", " ", "\n", ", ", "\n\n"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = spark.createDataFrame([(i, "p", t) for i, t in enumerate(texts)], "__id long, __path string, __text string").selectExpr("*", "xxhash64(__text) AS __k")
    got = sorted((r["__id"], r["line"], r["t"], r["key"]) for r in ls._windows(rows, headers).collect())
    want = []
    for i, text in enumerate(texts):
        placed = [(w, k) for k, line in enumerate(text.split("\n")) for w in ls._words(line)]
        for at in range(len(placed) - 1):
            for key, (h,) in headers.items():
                w = ls._words(h)
                line = placed[at][1]
                if [placed[at][0], placed[at + 1][0]] == w[:2] and (len(w) >= ls.TITLE or ls._words(text.split("\n")[line]) == w):
                    want.append((i, line, " ".join(x for x, _ in placed[at : at + len(w)]), f"{key}#0"))
    assert got == sorted(want) and len(want) > 20

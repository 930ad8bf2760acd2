import math
import textwrap

from pyspark.sql import functions as F

from sessionlake.llm import license_scan

APACHE = license_scan.TEMPLATES["Apache-2.0"]
MIT = license_scan.TEMPLATES["MIT"]
ROWS = [
    (1, "a/x.py", f"code\n{APACHE}\nmore code"),
    (2, "a/b/LICENSE", MIT),
    (3, "a/b/c/y.py", "no notice here"),
    (4, "a/z.py", "nothing"),
    (5, "COPYING.txt", license_scan.TEMPLATES["GPL-3.0"] + "\n" + MIT),
    (6, "q/w/e.py", None),
    (7, "q/w/f.py", "released under the mit license"),
    (8, None, "nothing"),
    (9, "a/b/g.py", "Released under the MIT License, said nobody who had ever read any of its few words"),
    (10, "a/b/c/long.py", "word " * 20_000 + "\n" + APACHE),
    (11, "a/b/c/d/", ""),
    (None, "a/b/n.py", APACHE),
    (12, "/LICENSE", "All rights reserved."),
    (13, "/abs/x.py", "text"),
]


def scan(spark, rows):
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    files = files.withColumn("license", F.lit("mine")).withColumn("directory", F.lit(3))
    return {r.doc_id: r for r in license_scan.scan_licences(files).collect()}


def test_headers_and_inheritance(spark):
    got = {id: (r.license, r.origin, r.from_directory, r.line) for id, r in scan(spark, ROWS).items()}
    assert got == {
        1: ("Apache-2.0", "header", None, 2),
        2: ("MIT", "header", None, 1),
        3: ("MIT", "directory", "a/b", None),
        4: ("GPL-3.0", "directory", "", None),
        5: ("GPL-3.0", "header", None, 1),
        6: ("GPL-3.0", "directory", "", None),
        7: ("MIT", "header", None, 1),
        8: (None, None, None, None),
        9: ("MIT", "directory", "a/b", None),
        10: ("Apache-2.0", "header", None, 2),
        11: ("MIT", "directory", "a/b", None),
        None: ("Apache-2.0", "header", None, 1),
        12: ("Proprietary", "header", None, 1),
        13: ("GPL-3.0", "directory", "", None),
    }


def test_scores_are_cosines(spark):
    """All lines against all templates, without anchors."""
    rows = [(i, "f", "\n".join([*license_scan.TEMPLATES.values(), f"Licensed {w} under the Apache License, Version 2.0", w])) for i, w in enumerate(["now", "the", "mit gnu"])]
    lines = [(i, n + 1, license_scan.term_counts(line)) for i, _, t in rows for n, line in enumerate(t.split("\n"))]
    templates = {k: license_scan.term_counts(t) for k, t in license_scan.TEMPLATES.items()}
    vocabulary = {w for c in templates.values() for w in c}
    df = {w: sum(w in c for _, _, c in lines) for w in vocabulary}
    weigh = lambda c: {w: n * license_scan.idf(len(lines), df.get(w, 0)) for w, n in c.items()}
    want = {}
    for i, n, counts in lines:
        a = weigh(counts)
        for name, template in templates.items():
            b = weigh(template)
            dot = sum(v * b.get(w, 0) for w, v in a.items())
            score = dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            if score >= 0.6:
                want[i, n, name] = round(score, 9)
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = license_scan.line_scores(spark, files, license_scan.TEMPLATES, 0.6, "doc_id", "text").collect()
    assert {(r.id, r.line, r.license): round(r.score, 9) for r in got} == want


def test_empty_table(spark):
    assert scan(spark, []) == {}


def commented(text, mark, width):
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(text, width))


def test_whole_notices(spark):
    """Licence texts, headers over several lines, and sentences that are wrapped or within a line."""
    text = {}
    for name, body in license_scan.NOTICES:
        text.setdefault(name, []).append(body)
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    rows = [
        (1, "a/LICENSE", "MIT License\n\nCopyright (c) 2020 A B\n\n" + textwrap.fill(text["MIT"][0], 70)),
        (2, "a/x.py", "nothing"),
        (3, "b.c", "/*\n" + commented(text["GPL-3.0"][0], " *", 60) + "\n */\nint x;"),
        (4, "c.c", commented(text["LGPL-3.0"][0].replace("program", "library"), "//", 72)),
        (5, "d.py", "import x\n" * 30 + commented(text["Apache-2.0"][0], "#", 50)),
        (6, "e/COPYING", "Copyright (c) 2020, X.\nAll rights reserved.\n\n" + textwrap.fill(text["BSD-3-Clause"][0], 75)),
        (7, "f.py", "code\n\n" + "\n".join(textwrap.wrap(gpl, 45)) + "\nmore"),
        (8, "g.py", f"All of this and all that belongs to it came here from far away. {gpl} Thank you, and please do read on."),
        (9, "h.py", "word " * 3000 + "\n" + textwrap.fill(text["MPL-2.0"][0], 40)),
        (10, "i/COPYING", text["GPL-3.0"][1].replace("Inc.", "Inc. <https://fsf.org/>\n") + "\nPreamble"),
        (11, "j.py", text["MIT"][0][:300]),
    ]
    got = {id: (r.license, r.origin, r.line) for id, r in scan(spark, rows).items()}
    assert got == {
        1: ("MIT", "header", 5),
        2: ("MIT", "directory", None),
        3: ("GPL-3.0", "header", 2),
        4: ("LGPL-3.0", "header", 1),
        5: ("Apache-2.0", "header", 31),
        6: ("BSD-3-Clause", "header", 4),
        7: ("GPL-3.0", "header", 3),
        8: ("GPL-3.0", "header", 1),
        9: ("MPL-2.0", "header", 2),
        10: ("GPL-3.0", "header", 1),
        11: (None, None, None),
    }

"""Licence scans: notices in the files themselves, and licence files that hold for a directory.

Every line of every file is compared with licence templates by the cosine of TF-IDF vectors.
Document frequencies are counted over all lines, for the words that occur in templates; other
words weigh as words never seen, so a line that says more than the template scores lower. A
line can reach the threshold only if it has one of a template's heaviest words, its anchors:
without them even a perfect match of the rest falls short. Only lines with an anchor are
expanded into words and joined with the templates.

Notices of several lines and licence texts are compared as a whole: ``NOTICES``, and the longer
templates once more, are aligned with all the words of a file, as decontamination does, whatever
the line breaks and comment marks between them. An alignment must reach the threshold as a share
of the notice, every different, added or missing word taking one away. Of the licences with texts
of thousands of words, the opening of the text stands for it.

A file's licence is that of its best whole notice, else its best line's, else that of the best
template over several lines or within one. A file without one inherits that of the nearest directory
above it which has a licence file, by joins on directory paths. Directories are reduced to
distinct ones before they are expanded into their ancestors, so a directory that holds a third
of all files is expanded once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.llm.common import text_of
from sessionlake.llm.decontaminate import alignments
from sessionlake.session import freeze

TOKEN = r"[\p{L}\p{N}]+"
THRESHOLD = 0.8
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"

#: Notices as their licences recommend them, by SPDX name where there is one. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Templates of fewer words are compared with lines only: a few words in a row may be chance.
WHOLE_WORDS = 8

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)


def _gnu(name: str, version: str, mark: str = ":") -> str:
    return (
        f"This program is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) "
        "any later version."
    )


def _gnu_text(title: str, dated: str, years: str) -> str:
    return (
        f"GNU {title} Version {dated} Copyright (C) {years} Free Software Foundation, Inc. Everyone is permitted to "
        "copy and distribute verbatim copies of this license document, but changing it is not allowed."
    )


#: SPDX name and notice, or text, or opening of the text. Fixed values.
NOTICES = [
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    ),
    ("BSD-2-Clause", _BSD + _WARRANTY),
    (
        "BSD-3-Clause",
        _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission. " + _WARRANTY,
    ),
    ("GPL-2.0", _gnu("General Public License", "2", ";")),
    ("GPL-2.0", _gnu_text("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-3.0", _gnu_text("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", ";")),
    ("LGPL-2.1", _gnu_text("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu_text("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", _gnu_text("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity "
        "that creates, contributes to the creation of, or owns Covered Software.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]


def term_counts(text: str) -> dict[str, int]:
    counts: dict[str, int] = {}
    for word in re.findall(r"[^\W_]+", text.lower()):
        counts[word] = counts.get(word, 0) + 1
    return counts


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _lines(files: DataFrame, id: str, text: str) -> DataFrame:
    """All lines with a word, numbered from one."""
    return files.select(F.col(id).alias("id"), F.posexplode(F.split(text_of(text), "\n")).alias("line", "content")).where(
        F.col("content").rlike(TOKEN)
    )


def document_frequencies(lines: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``term``, ``df`` for the template words, and the number of lines as the term null."""
    found = F.array_intersect(_terms(F.col("content")), F.array(*map(F.lit, vocabulary)))
    none = F.array(F.lit(None).cast("string"))
    return lines.select(F.explode(F.concat(found, none)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(lines: int, df: int) -> float:
    return math.log((1 + lines) / (1 + df)) + 1


def anchors(weights: dict[str, float], threshold: float) -> list[str]:
    """The heaviest words, so that all others together have less than ``threshold`` of the norm."""
    rest = math.sqrt(sum(w * w for w in weights.values()))
    limit, found = threshold * rest * (1 - 1e-9), []
    for word, weight in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        if rest < limit:
            break
        found.append(word)
        rest = math.sqrt(max(0.0, rest * rest - weight * weight))
    return found


def line_scores(
    spark: SparkSession, files: DataFrame, templates: dict[str, str], threshold: float, id: str, text: str
) -> DataFrame:
    """``id``, ``line``, ``license``, ``score`` of all lines and templates that reach the threshold."""
    counted = {name: term_counts(body) for name, body in templates.items()}
    vocabulary = sorted({w for counts in counted.values() for w in counts})
    lines = _lines(files, id, text)
    # One row per template word and one more.
    df = {r["term"]: r["df"] for r in document_frequencies(lines, vocabulary).collect()}
    total = df.get(None, 0)
    weight = {w: idf(total, df.get(w, 0)) for w in vocabulary}
    unseen = idf(total, 0)
    vectors, anchored = [], set()
    for name, counts in counted.items():
        vector = {w: n * weight[w] for w, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        vectors += [(name, w, v * weight[w] / norm) for w, v in vector.items()]
        anchored |= set(anchors(vector, threshold))
    any_anchor = r"(?<![\p{L}\p{N}])(" + "|".join(sorted(map(re.escape, anchored))) + r")(?![\p{L}\p{N}])"
    near = lines.where(F.lower("content").rlike(any_anchor))
    words = (
        near.select("id", "line", "content", F.explode(_terms(F.col("content"))).alias("term"))
        .groupBy("id", "line", "content", "term")
        .agg(F.count("*").alias("n"))
    )
    # Template vectors: as many rows as templates have words.
    template = F.broadcast(spark.createDataFrame(vectors, "license string, term string, part double"))
    seen = F.broadcast(spark.createDataFrame(list(weight.items()), "term string, weight double"))
    weighed = words.join(seen, "term", "left").withColumn("weight", F.coalesce("weight", F.lit(unseen)))
    norms = weighed.groupBy("id", "line", "content").agg(
        F.sqrt(F.sum(F.pow(F.col("n") * F.col("weight"), F.lit(2)))).alias("norm"),
        F.collect_list(F.struct("term", "n")).alias("terms"),
    )
    return (
        norms.select("id", "line", "content", "norm", F.inline("terms"))
        .join(template, "term")
        .groupBy("id", "line", "content", "license")
        .agg((F.sum(F.col("n") * F.col("part")) / F.max("norm")).alias("score"))
        .where(F.col("score") >= threshold)
        .select("id", (F.col("line") + 1).alias("line"), "license", "score")
    )


def notice_scores(
    files: DataFrame, notices: list[tuple[str, str]], threshold: float, id: str, text: str
) -> DataFrame:
    """``id``, ``line``, ``notice``, ``score`` of all files and notices, by place in the list, that reach the threshold.

    The line is that of the first words in common.
    """
    spark = files.sparkSession
    rows = files.select(F.col(id).alias("id"), text_of(text).alias("content"))
    wanted = spark.createDataFrame(list(enumerate(body for _, body in notices)), "notice long, body string")
    found = alignments(
        rows, wanted, id="id", text="content", item="notice", item_text="body", share=threshold, least=1, run=2**30
    )
    # The lines that end before the word.
    ends = F.aggregate(
        F.transform(F.split("content", "\n"), lambda line: F.size(_terms(line))),
        F.struct(F.lit(0).alias("words"), F.lit(1).alias("line")),
        lambda s, k: F.struct(
            (s["words"] + k).alias("words"), F.when(s["words"] + k <= F.col("first"), s["line"] + 1).otherwise(s["line"]).alias("line")
        ),
        lambda s: s["line"],
    )
    return (
        rows.withColumnRenamed("id", "_id")
        .join(found.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id")))
        .select("id", ends.alias("line"), "notice", (F.col("matched") / F.col("item_words")).alias("score"))
    )


def _directory(path: Column) -> Column:
    """Up to the last slash; empty for a file at the top; null for a null path."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)^(.*?)[^/]*$", 1), "/+$", "")


def scan_licences(
    files: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    notices: list[tuple[str, str]] | None = None,
    id: str = "doc_id",
    path: str = "path",
    text: str = "text",
) -> DataFrame:
    """Per file its id, ``path``, ``license``, ``score``, ``line``, ``origin`` and ``from_directory``.

    ``origin`` is ``header`` for a file's own notice, ``directory`` for an inherited one, else
    null. Whole notices come before lines, these before templates over several lines or within
    one. Of several the best score counts, then the first line, then the name. Of
    several licence files in one directory likewise, the name deciding between equal scores.
    Null and empty texts have no notice, a file without a path inherits none. Rows that share
    an id are one file with several texts; all rows are in the result.
    """
    spark = files.sparkSession
    templates = TEMPLATES if templates is None else templates
    lines = line_scores(spark, files, templates, threshold, id, text).select("id", F.lit(1).alias("tier"), "line", "license", "score")
    notices = NOTICES if notices is None else notices
    whole = notices + [(k, v) for k, v in templates.items() if sum(term_counts(v).values()) >= WHOLE_WORDS]
    names = F.array(*(F.lit(name) for name, _ in whole))
    aligned = notice_scores(files, whole, threshold, id, text).select(
        "id",
        F.when(F.col("notice") < len(notices), 0).otherwise(2).alias("tier"),
        "line",
        F.get(names, F.col("notice").cast("int")).alias("license"),
        "score",
    )
    best = F.min(F.struct("tier", (-F.round("score", 9)).alias("rank"), "line", "license", "score"))
    own = freeze(lines.unionByName(aligned).groupBy("id").agg(best.alias("own")))
    placed = files.select(F.col(id).alias("_id"), F.col(path).alias("path")).withColumn("directory", _directory(F.col("path")))
    named = F.regexp_extract(F.col("path"), r"(?s)([^/]*)$", 1)
    granted = (
        placed.where(named.rlike(LICENCE_FILE))
        .join(own, F.col("_id").eqNullSafe(F.col("id")))
        .groupBy(F.col("directory").alias("above"))
        .agg(F.min(F.struct("own.tier", "own.rank", "own.license")).alias("grant"))
    )
    parts = F.split("directory", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    nearest = (
        placed.where("directory IS NOT NULL")
        .select("directory")
        .distinct()
        .select("directory", F.explode(F.array_distinct(ancestors)).alias("above"))
        .join(granted, "above")
        .groupBy("directory")
        .agg(F.max_by(F.struct("above", "grant.license"), F.length("above")).alias("inherited"))
    )
    return (
        placed.join(own, F.col("_id").eqNullSafe(F.col("id")), "left")
        .join(nearest, "directory", "left")
        .select(
            F.col("_id").alias(id),
            "path",
            F.coalesce("own.license", "inherited.license").alias("license"),
            F.col("own.score").alias("score"),
            F.col("own.line").alias("line"),
            F.when(F.col("own").isNotNull(), "header").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
            F.when(F.col("own").isNull(), F.col("inherited.above")).alias("from_directory"),
        )
    )

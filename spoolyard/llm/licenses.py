"""Operator 2: licence scans by sparse TF-IDF cosine to templates, with inheritance from the nearest directory above."""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, once, read, small

#: Licence notices (fixed values).
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Least cosine of a header to its template.
LEAST = 0.85
_SPLIT = "[^a-z0-9]+"


#: Full names, for the short forms that name a licence.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License v3.0", "GNU AGPLv3"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "GPL-2.0": ("GNU General Public License v2.0", "GNU GPLv2"),
    "GPL-3.0": ("GNU General Public License v3.0", "GNU GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License v2.1", "GNU LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License v3.0", "GNU LGPLv3"),
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
}
SHORT = ("SPDX-License-Identifier: {0}", "{1}", "Released under the {1}.", "Licensed under the {1}.", "This project is licensed under the {1}.", "This project is licensed under the {1} - see the LICENSE file for details.")
_GNU = """This {0} is free software: you can redistribute it and/or modify it under the terms of the {1} as published by the Free
Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the {1} for more details. You should have received a copy of the {1} along with this {0}. If not, see
<https://www.gnu.org/licenses/>."""
#: Standard headers of source files.
HEADERS = {
    "AGPL-3.0": _GNU.format("program", "GNU Affero General Public License", "3"),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License.""",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-2.0": _GNU.format("program", "GNU General Public License", "2"),
    "GPL-3.0": _GNU.format("program", "GNU General Public License", "3"),
    "LGPL-2.1": _GNU.format("library", "GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _GNU.format("library", "GNU Lesser General Public License", "3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
#: One of these is in every template and in every text that is weighed against them.
TELLING = "(?i)licen[cs]|spdx|cc[ -]by|cc0|gnu|redistribut|permission is hereby"
#: Copyright statements, which name somebody else in each file and are no part of a licence.
COPYRIGHT = r"(?i)(?:copyright\s*(?:\(c\)|©)?|\(c\)|©)\s*\d{4}[^\n.]*\.?|all rights reserved\.?"
#: What begins a comment line.
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--|dnl\b|rem\b)"


def full_templates() -> list[tuple[str, str]]:
    """(license, text): notices, short forms, standard headers and the full texts of license_texts."""
    out = [*TEMPLATES.items(), *HEADERS.items()]
    out += [(k, form.format(k, name)) for k, names in NAMES.items() for name in names for form in SHORT]
    return out + [(f.stem, re.sub(COPYRIGHT, " ", f.read_text("utf-8"))) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def header_of(text: Column) -> Column:
    """The leading comment of a text, or its first paragraph where there is none."""
    text = F.ltrim(F.regexp_replace(text, r"\A#![^\n]*\n", ""))
    text = F.regexp_replace(text, r"\A\s+", "")
    lines = F.split(text, "\n")
    other = F.array_position(F.transform(lines, lambda x: x.rlike(COMMENT)), False)
    marked = F.array_join(F.when(other > 0, F.slice(lines, F.lit(1), (other - 1).cast("int"))).otherwise(lines), "\n")
    return (
        F.when(text.startswith("/*"), F.substring_index(text, "*/", 1))
        .when(text.startswith("<!--"), F.substring_index(text, "-->", 1))
        .when(text.startswith('\"\"\"'), F.get(F.split(text, '\"\"\"'), 1))
        .when(text.rlike(r"\A" + COMMENT[1:]), marked)
        .otherwise(F.get(F.split(text, r"\n[ \t\r]*\n"), 0))
    )


def scan_texts(files: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (path, line_no, license, cosine): for whole texts and header blocks (line_no 0) and single lines the nearest full template.

    Texts are weighed without copyright statements, as word counts times idf over the templates, ln((1 + templates) / (1 +
    templates with the word)) + 1; other words have the idf of a word in none. Only texts with a word of TELLING are, one
    of which every template has. Words are counted by (text, word), so a long text is no single row of many words.
    """
    spark = files.sparkSession
    named = full_templates()
    counts = [Counter(template_words(t)) for _, t in named]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log((1 + len(named)) / (1 + n)) + 1 for w, n in df.items()}
    other = math.log(1 + len(named)) + 1
    weights = []
    for (name, _), c, k in zip(named, counts, range(len(named)), strict=True):
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        weights += [(w, k, name, n * idf[w] / length) for w, n in c.items()]
    weighed = spark.createDataFrame([(w, i) for w, i in idf.items()], "word string, idf double").coalesce(1)
    weights = spark.createDataFrame(weights, "word string, template int, license string, weight double").coalesce(1)

    telling = files.where(F.col("path").isNotNull() & F.col("text").rlike(TELLING))
    at = lambda k, x: F.struct(k.cast("long").alias("line_no"), x.alias("unit"))
    units = F.concat(F.array(at(F.lit(0), F.col("text")), at(F.lit(0), header_of(F.col("text")))), F.transform(F.split("text", "\n"), lambda x, k: at(k, x)))
    units = telling.select("path", F.explode(F.array_distinct(units)).alias("u")).select("path", "u.line_no", "u.unit").where(F.col("unit").rlike(TELLING))
    units = keep(units.withColumn("id", F.monotonically_increasing_id()), "license-texts")
    words = units.select("id", F.explode(F.split(F.lower(F.regexp_replace("unit", COPYRIGHT, " ")), _SPLIT)).alias("word")).where("word <> ''")
    words = words.groupBy("id", "word").agg(F.count("*").alias("n")).join(F.broadcast(weighed), "word", "left")
    words = keep(words.select("id", "word", (F.col("n") * F.coalesce("idf", F.lit(other))).alias("w")), "license-words")
    norms = words.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = words.join(F.broadcast(weights), "word").groupBy("id", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "id").select("id", "license", F.round(F.col("dot") / F.col("norm"), 9).alias("cosine")).where(F.col("cosine") >= least)
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return units.join(best, "id").select("path", "line_no", F.col("b.license").alias("license"), (-F.col("b.less")).alias("cosine"))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, text.lower()) if w]


def anchors_of(idf: dict[str, float], templates: dict[str, str], least: float) -> list[str]:
    """Words one of which any line that reaches least must have: without its anchors a template's vector is too short.

    The cosine of a line to a template is at most the length of the template's part on the words that they share, over
    the template's length.
    """
    chosen: set[str] = set()
    for text in templates.values():
        w2 = {w: (n * idf[w]) ** 2 for w, n in Counter(template_words(text)).items()}
        rest = sum(v for w, v in w2.items() if w not in chosen)
        for w in sorted(w2, key=lambda w: (-w2[w], w)):
            if rest < (least * 0.999) ** 2 * sum(w2.values()):
                break
            if w not in chosen:
                chosen.add(w)
                rest -= w2[w]
    return sorted(chosen)


def scan_headers(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Rows (path, line_no, license, cosine): for each line of each text its nearest template, if the cosine is least or more.

    A line is a sparse vector of word counts times idf, ln((1 + lines) / (1 + lines with the word)) + 1; of words that no
    template has, the idf is that of a word in no line. Document frequencies are counted over all lines of all texts, for
    the templates' words only, so what comes to the driver is bounded by the templates. Lines without an anchor word (see
    anchors_of) cannot reach least and are passed over before anything is weighed. Ties go to the template first by name.

    Null paths and texts, empty and repeated rows are allowed: a null text has no lines. Empty tables give no rows.
    Further columns are not read.
    """
    templates = dict(sorted((templates or TEMPLATES).items()))
    vocabulary = sorted({w for t in templates.values() for w in template_words(t)})
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line")).where("line <> ''")
    vocab = F.array(*map(F.lit, vocabulary))
    known = lines.select(F.array_intersect(F.split(F.lower("line"), _SPLIT), vocab).alias("known"))
    # The lines are counted by a row of their own, under a name that is no word.
    seen = known.select(F.explode(F.concat("known", F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    df = {r.word: r.n for r in seen.collect()}
    total = df.pop("", 0)
    idf = {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in vocabulary}
    other = math.log(1 + total) + 1

    anchors = F.array(*map(F.lit, anchors_of(idf, templates, least)))
    idfs = F.array(*(F.lit(idf[w]) for w in vocabulary))
    lengths = {name: math.sqrt(sum((n * idf[w]) ** 2 for w, n in Counter(template_words(t)).items())) for name, t in templates.items()}

    def nearest(w: Column, c: Column) -> Column:
        """(-cosine, license) of the nearest template, from the sorted words and the counts of the vocabulary's."""
        # The squared counts of all words, by runs: n^2 grows by 2n - 1 with the n-th occurrence.
        start = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, x: F.struct(
            x.alias("word"),
            F.when(x == acc["word"], acc["run"] + 1).otherwise(F.lit(1).cast("long")).alias("run"),
            (acc["sum"] + F.when(x == acc["word"], 2 * acc["run"] + 1).otherwise(F.lit(1).cast("long"))).alias("sum"),
        )
        own = F.aggregate(c, F.lit(0).cast("long"), lambda s, n: s + n * n)
        inside = F.aggregate(F.zip_with(c, idfs, lambda n, i: n * i * n * i), F.lit(0.0), lambda s, v: s + v)
        norm = F.sqrt(inside + (F.aggregate(w, start, step)["sum"] - own) * F.lit(other * other))

        def scored(norm: Column) -> Column:
            out = []
            for name, text in templates.items():
                tf = sorted(Counter(template_words(text)).items())
                dot = sum((F.get(c, F.lit(vocabulary.index(x))) * F.lit(n * idf[x] ** 2) for x, n in tf), F.lit(0.0))
                out.append(F.struct((-F.round(dot / norm / F.lit(lengths[name]), 9)).alias("less"), F.lit(name).alias("license")))
            return F.array_min(F.array(*out))

        return once(norm, scored)

    def best(w: Column) -> Column:
        counts = F.transform(vocab, lambda word: F.size(F.filter(w, lambda x: x == word)))
        return once(counts, lambda c: nearest(w, c))

    # Generators keep the planner from repeating these expressions in filters.
    words = F.filter(F.array(F.split(F.lower("line"), _SPLIT)), lambda w: F.arrays_overlap(w, anchors))
    anchored = lines.select("path", F.col("line_no").cast("long").alias("line_no"), F.explode(words).alias("w"))
    found = F.filter(F.array(once(F.array_sort(F.filter("w", lambda x: x != "")), best)), lambda b: -b["less"] >= least)
    out = anchored.select("path", "line_no", F.explode(found).alias("best"))
    return out.select("path", "line_no", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine"))


def directory(path: Column) -> Column:
    """The directory of a path; "" for a path without one."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def inherit(paths: DataFrame, found: DataFrame, declares: Column) -> DataFrame:
    """Rows (path, license, cosine, inherited_from) for each row of paths.

    A file with a header keeps its best one (highest cosine, then first line, then name), inherited_from null. Any other
    takes the licence of the nearest directory above it, its own first, that has a licence file: a file with a header for
    which declares holds (over path, line_no). Of several in a directory the highest cosine counts, then the first path.
    Directories are joined by path, once for each distinct directory and not for each file; a path has as many as it has
    parts. Files with neither have nulls, and null paths have them, too; further columns of paths are not read. Empty tables
    give no rows. Paths have no fixed size, so how the joins are made is left to the planner, which measures what it broadcasts.
    """
    rank = F.struct((-F.col("cosine")).alias("less"), F.col("line_no"), F.col("license"))
    own = keep(found.where("path is not null").groupBy("path").agg(F.min(rank).alias("r")).select("path", F.col("r.license").alias("license"), (-F.col("r.less")).alias("cosine")), "headers")
    heads = found.where(declares & F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir"), F.struct((-F.col("cosine")).alias("less"), "path", "line_no", "license").alias("r"))
    files = heads.groupBy("dir").agg(F.min("r").alias("r")).select("dir", F.col("r.license").alias("dir_license"), (-F.col("r.less")).alias("dir_cosine"))
    files = keep(files, "directories")
    dirs = paths.select(directory(F.col("path")).alias("of")).where("of is not null").distinct()
    parts = F.split("of", "/")
    above = dirs.select("of", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))).alias("up")).select("of", "up.*").distinct()
    nearest = above.join(files, "dir").groupBy("of").agg(F.max(F.struct("depth", "dir", "dir_license", "dir_cosine")).alias("up"))
    nearest = keep(nearest.select("of", "up.dir", "up.dir_license", "up.dir_cosine"), "nearest")
    joined = paths.select("path", directory(F.col("path")).alias("of")).join(own, "path", "left").join(nearest, "of", "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "path", F.coalesce("license", "dir_license").alias("license"), F.when(has, F.col("cosine")).otherwise(F.col("dir_cosine")).alias("cosine"), F.when(~has, F.col("dir")).alias("inherited_from")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/thousands/hundreds/doc_id; one whose first line is a licence notice speaks for its directory.

    A document without an id is the file source/none.
    """
    n = F.col("doc_id").cast("long")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(n / 1000).cast("string"), F.floor(n / 100).cast("string"), F.coalesce(n.cast("string"), F.lit("none")))
    files = read(spark, sf_dir, "documents").select(path.alias("path"), "text")
    found = keep(scan_headers(files).union(scan_texts(files)), "licenses")
    out = inherit(files.select("path"), found, F.col("line_no") == 0)
    return out.select(F.substring_index("path", "/", -1).try_cast("long").alias("doc_id"), "path", "license", F.round("cosine", 4).alias("cosine"), "inherited_from")


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict = {}

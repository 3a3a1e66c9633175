"""Licence scans with DataFrame functions only.

A file is compared with licence templates, which are one-line notices, headers and whole licence texts, by the cosine of
sparse TF-IDF vectors. A template is compared with the file as a whole, with every line by itself, and with runs of
lines: from every line that has a term of it on, as many lines as have about its number of words, so that a notice
wrapped over the lines of a comment is one unit, whatever follows. Comment marks are no words, and lines that only name
a copyright holder are left out. Document frequencies of the templates' terms come from all files. A comparison is made
only if the terms in common carry at least the threshold's part of the template's length: by the Cauchy-Schwarz
inequality no other can reach it. A file whose whole text matches a template, or that is named as licence files are and has any match, is a licence
file of its directory; files without a notice of their own inherit from the nearest ancestor directory that has one, by
joins on paths.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.common import cut, fresh

# Public licence notices, headers and texts, by SPDX identifier.
_GNU = "This program is free software{c} you can redistribute it and/or modify it under the terms of the {g} as published by the Free Software Foundation{d} either version {v} of the License, or (at your option) any later version."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (
        _GNU.format(c=":", d=",", g="GNU Affero General Public License", v=3),
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (_BSD + " " + _AS_IS, "Licensed under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _AS_IS,
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        _GNU.format(c=";", d=";", g="GNU General Public License", v=2),
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU.format(c=":", d=",", g="GNU General Public License", v=3),
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        _GNU.format(c=":", d=",", g="GNU Lesser General Public License", v=3),
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
THRESHOLD = 0.75
#: How much longer than its template a run of lines may be.
LONGER = 1.1
_SPLIT = "[^a-z0-9]+"
#: Lines that name a holder or a year are no part of a licence's text.
COPYRIGHT = "^[^a-z0-9]*(copyright[^a-z0-9]+(c[^a-z0-9]|[0-9]{4})|\\(c\\)|©|all rights reserved[^a-z0-9]*$)"
#: Names of licence files.
LICENSE_FILE = "(?i)(^|/)(un)?(licen[cs]e|copying|notice)(\\.[a-z]+)?$"


def _terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
        out[t] = out.get(t, 0) + 1
    return out


def template_rows(templates: Mapping[str, Sequence[str]] = TEMPLATES) -> list[tuple[int, str, str, int]]:
    """(template number, licence, term, count) of all templates."""
    flat = [(name, text) for name in sorted(templates) for text in templates[name]]
    return [(i, name, t, n) for i, (name, text) in enumerate(flat) for t, n in sorted(_terms(text).items())]


def line_caps(templates: Mapping[str, Sequence[str]] = TEMPLATES) -> list[int]:
    """For each template the most words of a run of lines that is compared with it; templates of like length share one."""
    lengths = [sum(_terms(t).values()) for name in sorted(templates) for t in templates[name]]
    caps: list[int] = []
    for n in sorted(lengths, reverse=True):
        if not caps or n * LONGER * LONGER < caps[-1]:
            caps.append(int(n * LONGER))
    return [min(c for c in caps if c >= n) for n in lengths]


def _weighted(rows: list[tuple[int, str, str, int]], df: Mapping[str, int], n_files: int) -> tuple[list, float]:
    """Unit vectors of the templates as (template, licence, term, idf, weight), and the idf of a term that no template has."""
    idf = {t: math.log((n_files + 1) / (df.get(t, 0) + 1)) + 1 for _, _, t, _ in rows}
    norm: dict[int, float] = {}
    for i, _, t, n in rows:
        norm[i] = norm.get(i, 0.0) + (n * idf[t]) ** 2
    return [(i, name, t, idf[t], n * idf[t] / math.sqrt(norm[i])) for i, name, t, n in rows], math.log(n_files + 1) + 1


def _keys(vectors: list, least: float) -> list[str]:
    """The heaviest terms of each template, as many as leave the squares of its others together below `least`."""
    keys: set[str] = set()
    for i in {v[0] for v in vectors}:
        rest = 1.0
        for w, t in sorted(((w, t) for j, _, t, _, w in vectors if j == i), reverse=True):
            if rest < least:
                break
            keys.add(t)
            rest -= w * w
    return sorted(keys)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


def _lines(files: DataFrame, caps: Sequence[int]) -> DataFrame:
    """fid, j (from 0), line, terms, start: the words before the line, and ends: for each cap the last j of a run from here."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), F.when(~F.lower(x).rlike(COPYRIGHT), _tokens(x)).alias("terms")))
    lines = F.filter(lines, lambda u: F.size(u["terms"]) > 0)
    end = F.array(F.struct(F.lit(0).alias("line"), F.array().cast("array<string>").alias("terms")))  # where the last run ends
    lines = files.select("fid", F.posexplode(F.concat(lines, end)).alias("j", "u")).select("fid", "j", "u.*")
    before = Window.partitionBy("fid").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.size("terms")).over(before), F.lit(0)).cast("long"))
    reach = [F.max("j").over(Window.partitionBy("fid").orderBy("start").rangeBetween(0, cap)) for cap in caps]
    ends = F.array(*[F.greatest(r - 1, "j") for r in reach])  # the last line that starts within the cap ends beyond it
    return cut(lines.withColumn("ends", ends).where("line > 0"), "license-lines")


def notices(files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """fid, line, last, license, cosine: the best template of every unit that reaches the threshold.

    line, last: the first and last line of a unit; both 0 for the whole file. files: fid (not null, the same for equal
    files only), text. Ties go to the template that is first by licence and order.
    """
    spark = files.sparkSession
    rows, caps = template_rows(templates), line_caps(templates)
    classes = sorted(set(caps))
    least = (threshold * 0.999) ** 2
    terms = F.array(*[F.lit(t) for t in sorted({t for _, _, t, _ in rows})])
    present = files.select(F.array_intersect(terms, _tokens(F.coalesce("text", F.lit("")))).alias("present"))
    found = present.select(F.explode("present").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()  # one row a template term
    n_files = files.count()
    vectors, other = _weighted(rows, {r["term"]: r["n"] for r in found}, n_files)
    table = spark.createDataFrame([(t, i, name, float(w), caps[i], float(idf)) for i, name, t, idf, w in vectors], "term string, template int, license string, tw double, cap int, idf double")
    table = F.broadcast(table)  # the templates' terms: bounded
    keys = F.array(*[F.lit(t) for t in _keys(vectors, least)])
    some = files.where(F.arrays_overlap(_tokens(F.col("text")), keys)).select("fid", "text").dropDuplicates(["fid"])
    some = cut(some, "license-some")
    carried = F.sum(F.col("tw") * F.col("tw")).alias("carried")
    hits = some.select("fid", F.explode(F.array_intersect(terms, _tokens(F.col("text")))).alias("term")).join(table, "term")
    hits = cut(hits.groupBy("fid", "template").agg(carried).where(F.col("carried") >= least).select("fid", "template"), "license-hits")
    lines = _lines(some.join(hits.select("fid"), "fid", "left_semi"), classes)
    near = lines.select("fid", "j", "start", F.explode(F.array_intersect(terms, F.col("terms"))).alias("term")).join(table, "term").join(hits, ["fid", "template"])
    near = near.groupBy("fid", "j", "start", "template", "cap").agg(carried)
    # a run's lines carry what their terms carry together, or more; the frame, in 2^20ths of the cap, has one line more at most
    run = Window.partitionBy("fid", "template").orderBy(F.expr("start * 1048576L div cap")).rangeBetween(0, 1 << 20)
    runs = near.withColumn("all", F.sum("carried").over(run)).where(F.col("all") >= least).select("fid", "j", "cap").distinct()
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("cap")) - 1
    runs = runs.join(lines.select("fid", "j", "ends"), ["fid", "j"]).select("fid", "j", "cap", F.get("ends", place.cast("int")).alias("e"))
    units = near.where(F.col("carried") >= least).select("fid", "j", F.lit(0).alias("cap"), F.col("j").alias("e")).distinct()
    units = units.unionByName(runs)
    parts = units.select("fid", "cap", F.col("j").alias("s"), "e", F.explode(F.sequence("j", "e")).alias("j"))
    words = parts.join(lines.select("fid", "j", "line", "terms"), ["fid", "j"])
    whole = lines.select("fid", F.lit(0).alias("cap"), F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("line"), "terms")
    words = words.select(*whole.columns).unionByName(whole)
    unit = ["fid", "cap", "s", "e"]
    counts = words.select(*unit, "line", F.explode("terms").alias("term")).groupBy(*unit, "term").agg(F.count("*").alias("n"), F.min("line").alias("line"), F.max("line").alias("last"))
    counts = cut(counts, "license-units")
    weights = table.select("term", "idf").distinct()
    norms = counts.join(F.broadcast(weights), "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(other)))
    norms = norms.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.min("line").alias("line"), F.max("last").alias("last"))
    dots = counts.drop("line", "last").withColumnRenamed("cap", "of").join(table, "term").where("of = 0 or of = cap").withColumn("cap", F.col("of"))
    dots = dots.groupBy(*unit, "template", "license").agg(F.sum(F.col("n") * F.col("idf") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    best = F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("template")))
    return scored.groupBy("fid", "line", "last").agg(best.alias("b")).select("fid", "line", "last", "b.license", "b.cosine")


def directory(path: Column) -> Column:
    """The directory of a path, '' for the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """files' columns but the text, with license, origin ('notice', 'inherited' or null), cosine and found_in.

    A file's own licence is its best matching unit, the first of equals (the whole text, then the earliest and shortest
    run); found_in is the path it was found in. A file whose whole text matches, or that has a match and the name of a
    licence file, is one; of several in a directory the best match counts, then the first path.
    Defined results: a null or empty text has no licence of its own, but inherits; a null path neither gives nor inherits;
    repeated rows are files of their own; a path without a slash is in the top directory, which is the last ancestor of
    all; equal cosines go to the template that is first by licence and order; texts of any length are read whole; an
    empty table gives no rows.
    """
    rest = [c for c in files.columns if c != text_col]
    names = [fresh(files.drop(text_col), c) for c in ("license", "origin", "cosine", "found_in")]
    both = F.concat(F.hex(F.xxhash64(path_col, text_col)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), text_col, path_col)))
    fid = both.alias("fid")  # two hashes: one may be shared by different files of a large corpus
    found = cut(notices(files.select(fid, F.col(text_col).alias("text")), templates, threshold), "license-notices")
    own = found.groupBy("fid").agg(
        F.max_by(F.struct("license", "cosine"), F.struct("cosine", -F.col("line"), -F.col("last"))).alias("own"),
        F.max(F.when(F.col("line") == 0, F.struct("license", "cosine"))).alias("whole"),
    )
    kept = files.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(path_col).alias("path"), directory(F.col(path_col)).alias("dir"), fid)
    kept = cut(kept.join(own, "fid", "left").drop("fid"), "license-files")
    kept = kept.withColumn("whole", F.when(F.col("path").rlike(LICENSE_FILE), F.col("own")).otherwise(F.col("whole")))
    named = kept.where("whole is not null and path is not null")
    of_dir = named.groupBy("dir").agg(F.min(F.struct((-F.col("whole.cosine")).alias("c"), "path", F.col("whole.license").alias("license"))).alias("f"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("up")))
    dirs = kept.where("dir is not null").select("dir").distinct().select("dir", F.explode(up).alias("u")).select(F.col("dir").alias("under"), "u.*")
    nearest = dirs.join(of_dir, dirs["up"] == of_dir["dir"]).groupBy("under").agg(F.max_by("f", "depth").alias("f"))
    out = kept.join(nearest, kept["dir"] == nearest["under"], "left")
    has, heir = F.col("own").isNotNull(), F.col("f").isNotNull()
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)],
        F.when(has, F.col("own.license")).otherwise(F.col("f.license")).alias(names[0]),
        F.when(has, "notice").when(heir, "inherited").alias(names[1]),
        F.when(has, F.col("own.cosine")).otherwise(-F.col("f.c")).alias(names[2]),
        F.when(has, F.col("path")).otherwise(F.col("f.path")).alias(names[3]),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents as files of a tree source/lang/hundred/doc_id."""
    steps = [F.coalesce(F.col(c), F.lit("-")) for c in ("source", "lang")]
    number = F.col("doc_id").cast("string")
    return docs.select("doc_id", F.concat_ws("/", *steps, F.floor(F.col("doc_id") / 100).cast("string"), F.concat(number, F.lit(".txt"))).alias("path"), "text")

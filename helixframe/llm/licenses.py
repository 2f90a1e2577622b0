"""Licence statements by the Dice coefficient over word bigrams, in DataFrame functions only.

Units of a text are its lines, its paragraphs and the whole. A unit with n different bigrams can reach
a coefficient d with a template of m only if m lies between n * d / (2 - d) and n * (2 - d) / d; a
table by n holds the templates that remain, so a unit meets few of them and most units none.

Notices of one family differ in a few words only, which the coefficient hardly sees. A template that
reaches it holds only if the unit has the same distinguishing words and, where both name a version, the
same version.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import computed

THRESHOLD = 0.8

# Statements, notices and texts of common licences.
_BSD_FIRST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_LAST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

# Words that tell licences of one family apart, and words before a version.
MARKS = "affero lesser library noncommercial sharealike noderivatives noderivs nc sa nd endorse".split()
VERSION = "^(version|v|license|gpl|lgpl|agpl|attribution|noncommercial|sharealike|by|sa|nc|nd) ([0-9]+)$|^([0-9]+) clause$"

TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the terms of the Apache License 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause OR BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD_FIRST + _BSD_LAST),
    ("BSD-3-Clause", _BSD_FIRST + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_LAST),
    ("MIT", _MIT),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def marks(text: str) -> tuple[list[str], list[str]]:
    """The distinguishing words of a template, and its versions."""
    grams = template_bigrams(text)
    words = {w for g in grams for w in g.split()}
    return sorted(words & set(MARKS)), sorted({m[2] or m[3] for g in grams if (m := re.match(VERSION, g))})


def sizes(m: int, threshold: float) -> range:
    """The bigram counts of units that can reach the threshold with a template of ``m``."""
    return range(max(1, math.ceil(m * threshold / (2 - threshold) - 1e-9)), int(m * (2 - threshold) / threshold + 1e-9) + 1)


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, unit, line_no, license, dice``: the best template of each unit that reaches the threshold.

    A template must have the unit's distinguishing words, and none but its versions if both name some.
    ``unit`` is line, paragraph (of several lines) or text (of several lines); ``line_no`` counts the
    units of a kind from 1. Ties go to the earlier template. Null and empty texts have no unit that
    matches; null ids pass through; each of repeated rows is scanned on its own; an empty table gives
    no rows.
    """
    known = [template_bigrams(text) for _, text in templates]
    by_size: dict[int, list[int]] = {}
    for i, b in enumerate(known):
        for n in sizes(len(b), threshold) if b else ():
            by_size.setdefault(n, []).append(i)
    most = max(by_size, default=0)
    table = F.array(*(F.array(*map(F.lit, by_size.get(n, []))).cast("array<int>") for n in range(1, most + 1))) if most else F.array(F.array().cast("array<int>"))
    grams = F.array(*(F.array(*map(F.lit, b)) for b in known))
    names = F.array(*(F.lit(n) for n, _ in templates))

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, r"\r?\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), (i + 1).alias("line_no"), x.alias("said")))
    several = text.contains("\n")
    whole = F.when(several, F.array(F.struct(F.lit("text").alias("unit"), F.lit(1).alias("line_no"), text.alias("said"))))
    parts = F.transform(F.split(text, r"\r?\n[ \t]*\r?\n"), lambda x, i: F.struct(F.lit("paragraph").alias("unit"), (i + 1).alias("line_no"), x.alias("said")))
    parts = F.when(text.rlike(r"\n[ \t]*\r?\n"), F.filter(parts, lambda p: p["said"].contains("\n")))
    none = F.array().cast("array<struct<unit:string,line_no:int,said:string>>")
    units = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.explode(F.concat(lines, F.coalesce(whole, none), F.coalesce(parts, none))).alias("u")).select("doc_id", "u.*")
    split = computed(units, words=F.split(F.trim(F.regexp_replace(F.lower("said"), r"[^\p{L}\p{N}]+", " ")), " "))
    grown = computed(split.drop("said"), grams=_bigrams(F.col("words"))).drop("words").withColumn("n", F.size("grams")).where((F.col("n") >= 1) & (F.col("n") <= most))
    near = grown.withColumn("candidates", F.element_at(table, F.col("n"))).where(F.size("candidates") > 0)

    def judged(i: Column) -> Column:
        own = F.element_at(grams, i + 1)
        both = F.size(F.array_intersect("grams", own))
        return F.struct((2.0 * both / (F.col("n") + F.size(own))).alias("dice"), (-i).alias("at"))

    hits = computed(near, hits=F.filter(F.transform("candidates", judged), lambda h: h["dice"] >= threshold)).where(F.size("hits") > 0)
    told = [marks(text) for _, text in templates]
    strings = lambda lists: F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in lists))
    words, versions = strings(w for w, _ in told), strings(v for _, v in told)
    number = lambda g: F.concat(F.regexp_extract(g, VERSION, 2), F.regexp_extract(g, VERSION, 3))
    hits = computed(
        hits,
        words=F.array_sort(F.array_intersect(F.flatten(F.transform("grams", lambda g: F.split(g, " "))), F.array(*map(F.lit, MARKS)))),
        versions=F.array_sort(F.array_distinct(F.transform(F.filter("grams", lambda g: g.rlike(VERSION)), number))),
    )

    def same(h: Column) -> Column:
        version = F.element_at(versions, 1 - h["at"])
        return (F.element_at(words, 1 - h["at"]) == F.col("words")) & ((F.size(version) == 0) | (F.size("versions") == 0) | (version == F.col("versions")))

    best = hits.withColumn("best", F.array_max(F.filter("hits", same))).where("best is not null")
    return best.select("doc_id", "unit", "line_no", F.element_at(names, 1 - F.col("best.at")).alias("license"), F.col("best.dice").alias("dice"))


def oracle(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same for the table ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    listed = lambda x: f"[{', '.join(map(quoted, x))}]::VARCHAR[]"
    rows = ", ".join(f"({i}, {quoted(n)}, {quoted(t)}, {listed(marks(t)[0])}, {listed(marks(t)[1])})" for i, (n, t) in enumerate(templates))
    words = "string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
    WITH t AS (SELECT place, license, marks, versions, {grams} AS grams FROM (SELECT place, license, marks, versions, {words.format('said')} AS w FROM (VALUES {rows}) v(place, license, said, marks, versions))),
    u AS (
      SELECT doc_id, 'line' AS unit, unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS said, row FROM (SELECT doc_id, row_number() OVER () AS row, string_split_regex(coalesce(text, ''), '\\r?\\n') AS x FROM documents)
      UNION ALL SELECT doc_id, 'text', 1, text, row_number() OVER () FROM documents WHERE contains(text, chr(10))
      UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS said, row FROM (SELECT doc_id, row_number() OVER () AS row, string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n') AS x FROM documents WHERE regexp_matches(text, '\\n[ \\t]*\\r?\\n'))) WHERE contains(said, chr(10))
    ),
    g AS (SELECT doc_id, unit, line_no, row, {grams} AS grams FROM (SELECT *, {words.format('said')} AS w FROM u)),
    d AS (SELECT doc_id, unit, line_no, row, place, license, marks, versions, g.grams AS grams, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
          FROM g JOIN t ON len(g.grams) > 0 AND 2 * least(len(g.grams), len(t.grams)) >= {threshold} * (len(g.grams) + len(t.grams)) - 1e-9),
    e AS (SELECT *, list_sort(list_intersect(list_distinct(flatten([string_split(x, ' ') for x in grams])), {listed(MARKS)})) AS here,
          list_sort(list_distinct([regexp_extract(x, '{VERSION}', 2) || regexp_extract(x, '{VERSION}', 3) for x in grams if regexp_matches(x, '{VERSION}')])) AS said FROM d WHERE dice >= {threshold})
    SELECT doc_id, unit, line_no::INTEGER AS line_no, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY row, unit, line_no ORDER BY dice DESC, place) AS r FROM e
      WHERE marks = here AND (len(versions) = 0 OR len(said) = 0 OR versions = said)) WHERE r = 1
    """

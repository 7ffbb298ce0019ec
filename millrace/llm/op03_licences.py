"""Licence scan by Dice coefficients over word bigrams, DataFrame functions only.

The units of a text are its lines, its sentences, its paragraphs and each two or
three consecutive ones, its comment blocks (consecutive lines that begin with a
comment mark), and the whole. Each is lower-cased, cut into words of a-z and
0-9, and compared with the templates as a set of word bigrams. With m and n
bigrams the coefficient is at most 2 min(m, n) / (m + n), so a template is
compared only if its size lies within the bounds that ``LEAST`` sets for the
unit's size, and only if the whole text has as many of its bigrams as a match
needs. A match has so many bigrams of its template that it holds one of the few
words in ``anchors``, so texts without any of them are not cut up at all. All
is done within a row: nothing is exploded or shuffled.

Returned per document: n_notices (distinct units, as word sequences, that match
some template), licences (the best template's licence of each such unit,
distinct, sorted, comma-joined; ties go to the smaller name) and best_score.
Defined results: null and empty texts have no notices and a score of 0; one word
has no bigram and never matches; repeated rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

LEAST = 0.8

# Public licence names, forms of notice, and short licence texts.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "Unlicense": ("Unlicense",),
}
FORMS = ("Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.")
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
}


_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """is free software: you can redistribute it and/or modify it under the terms of the GNU {0} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {1} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} General Public License for more details. You should have received a copy of the GNU {0} General Public License along with {1}. If not, see https://www.gnu.org/licenses/."""
TEXTS |= {
    "BSD-2-Clause": _BSD.format(""),
    "BSD-3-Clause": _BSD.format(" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0": "This library " + _GNU.format("Lesser", "This library"),
    "AGPL-3.0": "This program " + _GNU.format("Affero", "This program"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def plain_words(text: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def templates() -> list[tuple[str, list[str]]]:
    """(licence, sorted distinct bigrams) of every template."""
    found = [(k, form.format(name)) for k, names in NAMES.items() for name in names for form in FORMS] + list(TEXTS.items())
    out = []
    for licence, text in found:
        w = plain_words(text)
        out.append((licence, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})))
    return out


def bounds(size: int, least: float = LEAST) -> tuple[float, float]:
    """Sizes that a set of ``size`` bigrams can match."""
    return size * least / (2 - least), size * (2 - least) / least


#: Words that texts of every kind hold, which prune nothing.
EVERYDAY = frozenset("the of is by to in and or a this that it be for with any at as not you on from under work may use all an are can if see other no but including which has have was 0 1 2 3 4".split())


def anchors(least: float = LEAST) -> list[str]:
    """Words of which every match holds one: a match lacks at most
    1 - least / (2 - least) of a template's bigrams, so words that stand in more
    of them than that are enough. Chosen greedily over all templates."""
    spare = {i: len(b) - len(b) * least / (2 - least) for i, (_, b) in enumerate(templates())}
    left = {i: list(b) for i, (_, b) in enumerate(templates())}
    met = dict.fromkeys(left, 0)
    chosen: list[str] = []
    while any(met[i] <= spare[i] for i in left):
        gain: dict[str, float] = {}
        for i, pairs in left.items():
            lack = spare[i] - met[i]
            if lack >= 0:
                for word in {w for pair in pairs for w in pair.split()} - EVERYDAY:
                    # How much of what the template still lacks the word brings.
                    gain[word] = gain.get(word, 0) + min(1.0, sum(word in p.split() for p in pairs) / (lack + 1))
        word = max(sorted(gain), key=gain.get)
        chosen.append(word)
        for i, pairs in left.items():
            rest = [p for p in pairs if word not in p.split()]
            met[i], left[i] = met[i] + len(pairs) - len(rest), rest
    return sorted(chosen)


#: What begins a comment line; what ends a sentence; lines without letters or digits.
_COMMENT, _SENTENCE, _GAP = r"^[ \t]*(//|#|\*|/\*|--|;|%|<!--)", r"[.!?]+[ \t\r\n]+", r"\n([^A-Za-z0-9\n]*\n)+"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def units(text: Column) -> Column:
    """Texts of all units of a text."""

    def bound(value: Column, use) -> Column:
        return F.flatten(F.transform(F.array(value), use))

    def several(parts: Column) -> Column:
        n = F.size(parts)

        def runs(k: int) -> Column:
            joined = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(parts, i, k), "\n"))
            return F.when(n >= k, joined).otherwise(F.array().cast("array<string>"))

        return F.concat(parts, runs(2), runs(3))

    lines = F.split(text, "\n", -1)
    marked = bound(lines, lambda ls: F.split(F.array_join(F.transform(ls, lambda l: F.when(l.rlike(_COMMENT), l).otherwise("\x01")), "\n"), "(\n?\x01)+\n?", -1))
    return F.concat(lines, F.split(text, _SENTENCE, -1), bound(F.split(text, _GAP, -1), several), marked, F.array(text))


def unit_words(unit: Column) -> Column:
    # Only ASCII letters change case.
    return F.filter(F.split(F.regexp_replace(F.translate(unit, _LETTERS, _LETTERS.lower()), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def scan(docs: DataFrame, keep: list[str], least: float = LEAST) -> DataFrame:
    """The columns in ``keep`` with n_notices, licences and best_score."""
    known = templates()
    low, high = min(bounds(len(b), least)[0] for _, b in known), max(bounds(len(b), least)[1] for _, b in known)
    table = F.array(*[F.struct(F.lit(k).alias("licence"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("bigrams")) for k, b in known])
    every = F.array(*map(F.lit, sorted({x for _, b in known for x in b})))
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = text.rlike(f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(anchors(least))})(?![A-Za-z0-9])")
    rows = docs.select(*keep, F.when(likely, text).otherwise("").alias("_text"))
    rows = rows.select(*keep, "_text", F.array_intersect(_bigrams(unit_words(F.col("_text"))), every).alias("_shared"))
    # A unit that matches has n * least / (2 - least) bigrams of the template at least, and so has the text.
    may = F.filter(table, lambda t: F.size(F.array_intersect(t["bigrams"], F.col("_shared"))) * (2 - least) >= t["n"] * least)
    rows = rows.select(*keep, "_text", F.when(F.size("_shared") >= low, may).otherwise(F.slice(table, 1, 0)).alias("_known"))
    cut = F.when(F.size("_known") > 0, F.array_distinct(F.transform(units(F.col("_text")), unit_words))).otherwise(F.array().cast("array<array<string>>"))
    rows = rows.select(*keep, "_known", cut.alias("_units"))
    # A unit of w words has at most w - 1 bigrams, and no fewer than those of one template must be distinct.
    sets = F.filter(F.transform(F.filter("_units", lambda u: F.size(u) > low), _bigrams), lambda b: (F.size(b) >= low) & (F.size(b) <= high))
    rows = rows.select(*keep, "_known", sets.alias("_sets"))

    def best(unit: Column) -> Column:
        n = F.size(unit)
        near = F.filter("_known", lambda t: (t["n"] * (2 - least) >= n * least) & (n * (2 - least) >= t["n"] * least))
        judged = F.transform(near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(t["bigrams"], unit)) / (n + t["n"])).alias("minus"), t["licence"].alias("licence")))
        return F.array_min(judged)

    hits = F.filter(F.transform("_sets", best), lambda h: h.isNotNull() & (h["minus"] <= -least))
    rows = rows.select(*keep, hits.alias("_hits"))
    return rows.select(
        *keep,
        F.size("_hits").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["licence"]))), ",").alias("licences"),
        F.coalesce(-F.array_min(F.transform("_hits", lambda h: h["minus"])), F.lit(0.0)).alias("best_score"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), ["doc_id"])


def oracle() -> str:
    values = ",\n".join(f"('{k}', [{', '.join(repr(x) for x in b)}])" for k, b in templates())
    return f"""
WITH template(licence, bigrams) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
paragraphs AS (SELECT rid, string_split_regex(text, '{_GAP}') AS p FROM d),
unit_text AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS u FROM d
  UNION ALL SELECT rid, unnest(string_split_regex(text, '{_SENTENCE}')) FROM d
  UNION ALL SELECT rid, array_to_string(p[i + 1 : i + k], chr(10)) FROM paragraphs, (VALUES (1), (2), (3)) AS size(k), unnest(range(len(p) - k + 1)) AS r(i)
  UNION ALL SELECT rid, unnest(string_split_regex(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '{_COMMENT}') THEN l ELSE chr(1) END), chr(10)), '(\\n?\\x01)+\\n?')) FROM d
  UNION ALL SELECT rid, text FROM d
),
unit AS (
  SELECT row_number() OVER () AS uid, rid, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigrams FROM (
    SELECT DISTINCT rid, list_filter(string_split_regex(translate(u, '{_LETTERS}', '{_LETTERS.lower()}'), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM unit_text) WHERE len(words) > 1
),
scored AS (
  SELECT uid, rid, licence, 2.0 * len(list_intersect(template.bigrams, unit.bigrams)) / (len(template.bigrams) + len(unit.bigrams)) AS dice
  FROM unit, template WHERE len(template.bigrams) * {2 - LEAST} >= len(unit.bigrams) * {LEAST} AND len(unit.bigrams) * {2 - LEAST} >= len(template.bigrams) * {LEAST}
),
best AS (SELECT rid, licence, dice FROM scored WHERE dice >= {LEAST} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, licence) = 1)
SELECT d.doc_id, count(b.rid) AS n_notices, coalesce(string_agg(DISTINCT b.licence, ',' ORDER BY b.licence), '') AS licences, coalesce(max(b.dice), 0.0)::DOUBLE AS best_score
FROM d LEFT JOIN best b USING (rid) GROUP BY d.rid, d.doc_id
"""

"""License scans by the Dice coefficient of word bigrams (operator 8), in DataFrame functions only.

A text is lower-cased, every run of other characters than letters, digits and line feeds becomes a space, and its units are
compared with the templates: each line, each paragraph of several lines, the whole text, and windows. A notice inside a longer line or across lines is found by
its window: as many words as a template has, so placed that a word of which each match must hold one stands where the template has it; it is compared with the
templates of so many words. The size of a unit bounds its
Dice coefficient with a template (2 min / (sum of sizes)), so units outside the sizes of all templates go before any
bigram is made, and templates outside the bounds of a unit are not compared. The same bound gives words of which each match must hold one, and
texts and units without any go first. All is done within a row: no shuffle.

Defined results: a null or empty text has no matches; a unit of fewer than two words has no bigrams and matches nothing; a unit
that reaches the threshold with several templates gives the one of the greatest coefficient, the first by name among equals; a notice with words added
may show in several windows, and close relatives of another size (the GNU notices) in windows of their own with lesser coefficients; repeated rows give repeated matches; an empty
table gives an empty result; columns of the input that clash with results are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8

# Licence texts, grants and notices in common use, by SPDX identifier.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version."
TEMPLATES = {
    "AGPL-3.0/notice": _GNU.format("program", ":", "Affero General Public License", ",", "3"),
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause/text": f"{_BSD} {_BSD_AS_IS}",
    "BSD-2-Clause/grant": _BSD,
    "BSD-3-Clause/text": f"{_BSD} {_BSD_3} {_BSD_AS_IS}",
    "BSD-3-Clause/grant": f"{_BSD} {_BSD_3}",
    "BSL-1.0/notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0/line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/notice": _GNU.format("program", ";", "General Public License", ";", "2"),
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": _GNU.format("program", ":", "General Public License", ",", "3"),
    "ISC/text": f"{_ISC} THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC/grant": _ISC,
    "LGPL-2.1/notice": _GNU.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0/notice": _GNU.format("program", ":", "Lesser General Public License", ",", "3"),
    "MIT/line": "Released under the MIT License.",
    "MIT/grant": _MIT,
    "MIT/disclaimer": _AS_IS,
    "MIT/text": f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/grant": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib/text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
COMMON = frozenset("a an and any are as at be by can do either for if in is it its may not of on or that the this to use was were with without you".split())
OTHER = r"[^\p{L}\p{N}\n]+"


def bigrams(text: str) -> list[str]:
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def anchors(templates: dict[str, str], threshold: float) -> dict[str, list[str]]:
    """By template, words of which every match holds one. A match shares at least threshold / (2 - threshold) of a template's bigrams; words
    that touch more bigrams than may be missing can't all be absent. Long words are taken first, as they are rare."""
    chosen: set[str] = set()
    found: dict[str, list[str]] = {}
    for name, text in templates.items():
        own, mine = bigrams(text), []
        missing = int((1 - threshold / (2 - threshold)) * len(own) + 1e-9)
        touched: set[str] = set()
        for word in sorted({w for g in own for w in g.split()}, key=lambda w: (w not in chosen, w in COMMON, -len(w), w)):
            if len(touched) > missing:
                break
            if new := {g for g in own if word in g.split()} - touched:
                touched |= new
                mine.append(word)
        chosen.update(mine)
        found[name] = mine
    return found


def places(templates: dict[str, str], threshold: float) -> list[tuple[str, int, int]]:
    """(word, place, words of the template) of every anchor in every template, each once."""
    some = anchors(templates, threshold)
    rows = {(w, k, len(own)) for name, text in templates.items() for own in [words_of(text)] for k, w in enumerate(own) if w in some[name]}
    return sorted(rows)


def _units(clean: Column) -> Column:
    """Structs of kind, number and words: lines, paragraphs of several lines, and whole texts of several lines."""

    def numbered(kind: str, parts: Column, several: bool) -> Column:
        words = lambda p: F.split(F.trim(F.translate(p, "\n", " ")), " +") if several else F.split(F.trim(p), " ")
        made = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("kind"), (i + 1).cast("int").alias("unit"), words(p).alias("words"), F.contains(p, F.lit("\n")).alias("several")))
        return F.filter(made, lambda u: u["several"]) if several else made

    return F.concat(numbered("line", F.split(clean, "\n"), False), numbered("paragraph", F.split(clean, r"\n *\n[ \n]*"), True), numbered("text", F.array(clean), True))


def _pairs(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))


def _best(grams: Column, table: Column, threshold: float, size: Column | None = None) -> Column:
    """The greatest (dice, order, license) of a set of bigrams over the templates that its size allows, or over those of so many words only."""
    n = F.size(grams)
    within = F.filter(table, lambda t: (F.lit(True) if size is None else t["size"] == size) & (2 * F.least(n, t["m"]) >= F.lit(threshold) * (n + t["m"])))
    return F.array_max(F.transform(within, lambda t: F.struct(F.round(2 * F.size(F.array_intersect(grams, t["grams"])) / (n + t["m"]), 9).alias("dice"), t["order"].alias("order"), t["license"].alias("license"))))


def _windows(every: Column, at: list[tuple[str, int, int]], table: Column, threshold: float) -> Column:
    """Structs of number (the first word's) and best of the windows of a text's words that reach the threshold. A window is compared where it stands, so that a text holds
    a number for each, and never the words of all."""
    by_word: dict[str, list[Column]] = {}
    wide = max(size for _, _, size in at) + 1
    for word, place, size in at:
        by_word.setdefault(word, []).append(F.struct(F.lit(place).alias("place"), F.lit(size).alias("size")))
    known = F.create_map(*[x for w, own in by_word.items() for x in (F.lit(w), F.array(*own))])
    held = F.filter(F.transform(every, lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: F.array_contains(F.array(*map(F.lit, by_word)), x["word"]))

    def coded(i: Column, a: Column) -> Column:
        """First word, template size and number of words of a window, cut at the ends of the text, as one number: those are told apart in one pass."""
        start = i - a["place"]
        first = F.greatest(start, F.lit(0))
        length = F.least(a["size"] + F.least(start, F.lit(0)), F.size(every) - first)
        return (first.cast("long") * wide + a["size"]) * wide + length

    codes = F.array_distinct(F.flatten(F.transform(held, lambda x: F.transform(F.element_at(known, x["word"]), lambda a: coded(x["i"], a)))))

    def compared(code: Column) -> Column:
        first, size, length = F.floor(code / (wide * wide)).cast("int"), (F.floor(code / wide) % wide).cast("int"), (code % wide).cast("int")
        # each step binds what it made before, so that nothing is made twice
        best = F.transform(F.transform(F.array(F.slice(every, first + 1, length)), _pairs), lambda g: _best(g, table, threshold, size))
        return F.struct((first + 1).alias("unit"), best[0].alias("b"))

    return F.filter(F.transform(codes, compared), lambda x: x["b"]["dice"] >= threshold)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, unit, license, dice) of every unit whose greatest Dice coefficient with a template is at least the threshold.

    A whole text or paragraph of a single line isn't compared again as such.
    """
    templates = TEMPLATES if templates is None else templates
    grams = {k: bigrams(templates[k]) for k in sorted(templates)}
    low = min(threshold / (2 - threshold) * len(g) for g in grams.values())
    high = max((2 - threshold) / threshold * len(g) for g in grams.values())
    strings = lambda g: F.array(*map(F.lit, g))
    table = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(-i).alias("order"), F.lit(len(words_of(templates[k]))).alias("size"), F.lit(len(g)).alias("m"), strings(g).alias("grams")) for i, (k, g) in enumerate(grams.items())])
    known = strings(dict.fromkeys(x for g in grams.values() for x in g))
    some = sorted({w for own in anchors(templates, threshold).values() for w in own})
    clean = F.regexp_replace(F.lower(F.col(text_col)), OTHER, " ")
    held = docs.where(F.lower(F.col(text_col)).rlike(r"(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, some)) + r")(?![\p{L}\p{N}])"))
    # values that later steps use more than once are made by generators, so that the optimiser doesn't repeat the making
    cleaned = held.select(F.col(id_col).alias("doc_id"), F.explode(F.array(clean)).alias("clean"))
    units = cleaned.select("doc_id", F.explode(_units(F.col("clean"))).alias("u")).select("doc_id", "u.*")
    # a repeated bigram makes the set smaller than the number of words, so the upper bound is held against the set
    sized = units.where((F.size("words") - 1 >= low) & F.arrays_overlap("words", strings(some)))
    made = sized.select("doc_id", "kind", "unit", F.explode(F.array(_pairs(F.col("words")))).alias("grams"))
    near = made.where((F.size("grams") <= high) & F.arrays_overlap("grams", known))
    best = near.select("doc_id", "kind", "unit", F.explode(F.array(_best(F.col("grams"), table, threshold))).alias("b")).where(F.col("b.dice") >= threshold)
    every = cleaned.select("doc_id", F.explode(F.array(F.split(F.trim(F.regexp_replace("clean", "[ \n]+", " ")), " "))).alias("every"))
    inside = every.select("doc_id", F.explode(_windows(F.col("every"), places(templates, threshold), table, threshold)).alias("w")).select("doc_id", F.lit("window").alias("kind"), "w.unit", "w.b")
    return best.unionByName(inside).select("doc_id", "kind", "unit", "b.license", "b.dice")


def op8(docs: DataFrame) -> DataFrame:
    return find_licenses(docs)


def _sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(k)}, {len(words_of(v))}, [{', '.join(map(quoted, bigrams(v)))}])" for k, v in TEMPLATES.items())
    at = ", ".join(f"({quoted(w)}, {k}, {n})" for w, k, n in places(TEMPLATES, THRESHOLD))
    some = ", ".join(sorted({quoted(w) for w, _, _ in places(TEMPLATES, THRESHOLD)}))
    return rf"""
WITH t(license, n_words, grams) AS (VALUES {table}),
a(word, place, size) AS (VALUES {at}),
c AS (SELECT doc_id, regexp_replace(lower(text), '{OTHER}', ' ', 'g') AS clean FROM documents WHERE text IS NOT NULL),
parts AS (
  SELECT doc_id, 'line' AS kind, unnest(string_split(clean, chr(10))) AS part, generate_subscripts(string_split(clean, chr(10)), 1) AS unit FROM c
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(regexp_split_to_array(clean, '\n *\n[ \n]*')) AS part, generate_subscripts(regexp_split_to_array(clean, '\n *\n[ \n]*'), 1) FROM c) WHERE contains(part, chr(10))
  UNION ALL SELECT doc_id, 'text', clean, 1 FROM c WHERE contains(clean, chr(10))),
whole AS (SELECT doc_id, string_split(trim(regexp_replace(clean, '[ \n]+', ' ', 'g')), ' ') AS words FROM c),
held AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM whole WHERE list_has_any(words, [{some}])),
starts AS (SELECT DISTINCT doc_id, i - place AS start, size FROM held JOIN a USING (word)),
w AS (SELECT doc_id, kind, unit, 0 AS size, string_split(trim(regexp_replace(part, '[ \n]+', ' ', 'g')), ' ') AS words FROM parts
  UNION ALL SELECT DISTINCT doc_id, 'window', greatest(start, 0) + 1, size, words[greatest(start, 0) + 1 : start + size] FROM starts JOIN whole USING (doc_id)),
g AS (SELECT doc_id, kind, unit, size, words, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
d AS (SELECT doc_id, kind, unit, size, words, license, round(2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), 9) AS dice FROM g JOIN t ON g.size = 0 OR g.size = t.n_words)
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, dice FROM d WHERE dice >= {THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, kind, unit, size, words ORDER BY dice DESC, license) = 1
"""


OP8_SQL = _sql()

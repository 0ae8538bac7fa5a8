"""License scan: Dice coefficient of word bigrams against license templates.

A text is put in lower case, everything but letters, digits and line ends becomes
space. What is compared are its lines, its paragraphs (runs of lines between blank
ones) and the whole, each piece once. A piece whose number of distinct bigrams lies
outside [t/(2-t), (2-t)/t] times a template's cannot reach the coefficient t and isn't
compared with it. Before that, a piece must hold one of the anchor words: any piece that
reaches t against a template shares a fixed share of its bigrams, so it has one of the
template's rarest third, and with it that bigram's rarer word; this loses nothing.

A template that spans several lines or paragraphs is met by windows: runs of lines of any
length that reach t. Of overlapping windows of one template, and of windows of similar size
that share over half the lines of the shorter, the one with the highest coefficient is
reported, unless it is a line, a paragraph or the whole. Only texts with enough of a template's bigrams are
searched, and of windows only those that lose shared bigrams without their first or last
line; any other has a shorter one inside that scores no less.

All of it is column expressions in one pass: no shuffle, no join, no Python on executors.

Defined results: null and empty texts have no piece and no row. Each row of the input is
scanned by itself, so repeated rows give repeated results, and null ids are carried as null.
Of equal coefficients the template that is first by name wins. A very long text is compared
by its lines, paragraphs and windows like any other. An empty table gives an empty table. Only
doc_id and text are read, so the names of other columns can't clash.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalquarry.llm.common import once

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD3_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

#: Public license texts and the notices that stand for them.
TEMPLATES: dict[str, str] = {
    "agpl-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": _BSD2,
    "bsd-3-clause": _BSD2.replace(" THIS SOFTWARE IS", f" {_BSD3_CLAUSE} THIS SOFTWARE IS", 1),
    "bsd/line": "Released under the BSD License.",
    "cc-by-4.0/line": "Licensed under CC BY 4.0.",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0/line": "Licensed under CC BY-SA 4.0.",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "isc": _ISC + """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc/notice": _ISC,
    "mit": _MIT,
    "mit/line": "Released under the MIT License.",
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "public-domain/line": "This work is released into the public domain.",
    "unlicense": _UNLICENSE + """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "unlicense/notice": _UNLICENSE,
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "zlib/notice": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
}
#: Frequent English words, from the most frequent on.
FREQUENT = "the of and to a in is that for it as with be on by at this are or from an was not you if will all any no in 1 2 3 4 0 5 may who its use see work such".split()

_KEPT = r"[^\p{L}\p{N}\n]+"


def words_of(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def _share(threshold: float) -> tuple[int, int]:
    """t / (2 - t) as a fraction of whole numbers: bounds in floating point lose the pieces
    that lie on them."""
    t = Fraction(str(threshold))
    return (t / (2 - t)).as_integer_ratio()


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which any piece that reaches the threshold has one."""
    rarity = lambda w: FREQUENT.index(w) if w in FREQUENT else len(FREQUENT)
    out = set()
    for text in templates.values():
        pairs = [tuple(b.split(" ")) for b in bigrams_of(text)]
        num, rest = _share(threshold)
        least = -(-num * len(pairs) // rest)
        pairs.sort(key=lambda p: (-max(map(rarity, p)), p))
        out |= {max(p, key=lambda w: (rarity(w), w)) for p in pairs[: len(pairs) - least + 1]}
    return sorted(out)


def _bigrams(words: Column) -> Column:
    n = F.size(words)
    pair = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.when(n > 1, F.array_distinct(pair)).otherwise(F.array().cast("array<string>"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _windows(plain: DataFrame, known: list[dict], threshold: float) -> DataFrame:
    """The windows of texts with norm and lines, in the columns of scan()."""
    num, rest = _share(threshold)
    known = [t | {"least": -(-num * t["n"] // rest)} for t in known]
    table = F.from_json(F.lit(json.dumps(known)), "array<struct<license:string,grams:array<string>,n:int,least:int>>")
    every = F.array(*(F.lit(g) for g in sorted({g for t in known for g in t["grams"]})))
    met = once(plain, "words", F.filter(F.split("norm", "[ \n]+", -1), lambda w: w != ""))
    met = once(met.where(F.size("words") > 1), "met", F.array_intersect(_bigrams(F.col("words")), every)).drop("words")
    asked = F.filter(table, lambda t: (F.size("met") >= t["least"]) & (F.size(F.array_intersect("met", t["grams"])) >= t["least"]))
    met = once(met.where(F.size("met") > 0), "asked", asked).where(F.size("asked") > 0).drop("met")
    in_line = lambda t, i: F.transform(F.filter(F.split(t, " +", -1), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("i")))
    met = once(met, "placed", F.flatten(F.transform("lines", in_line)))
    at = lambda i: F.element_at("placed", i)
    pair = lambda i: F.struct(F.concat_ws(" ", at(i)["w"], at(i + 1)["w"]).alias("g"), at(i)["i"].alias("a"), at(i + 1)["i"].alias("b"))
    met = once(met, "pairs", F.transform(F.sequence(F.lit(1), F.size("placed") - 1), pair)).drop("placed")
    distinct = lambda pairs, a, b: F.size(F.array_distinct(F.transform(F.filter(pairs, lambda p: (p["a"] >= a) & (p["b"] <= b)), lambda p: p["g"])))

    def of_template(t: Column) -> Column:
        def of_hits(hits: Column) -> Column:
            spans = lambda a: F.transform(F.filter(F.array_distinct(F.transform(hits, lambda h: h["b"])), lambda b: b >= a), lambda b: F.struct(a.alias("a"), b.alias("b"), distinct(hits, a, b).alias("m")))
            enough = F.filter(F.flatten(F.transform(F.array_distinct(F.transform(hits, lambda h: h["a"])), spans)), lambda w: w["m"] >= t["least"])
            tight = F.filter(enough, lambda w: (distinct(hits, w["a"] + 1, w["b"]) < w["m"]) & (distinct(hits, w["a"], w["b"] - 1) < w["m"]))
            sized = F.transform(tight, lambda w: F.struct(w["a"].alias("a"), w["b"].alias("b"), w["m"].alias("m"), distinct(F.col("pairs"), w["a"], w["b"]).alias("n")))
            dice = lambda w: F.round(2.0 * w["m"] / (w["n"] + t["n"]), 6)
            return F.transform(sized, lambda w: F.struct((-dice(w)).alias("d"), t["license"].alias("license"), w["a"].alias("a"), w["b"].alias("b"), w["n"].alias("n")))

        return _let(F.filter("pairs", lambda p: F.array_contains(t["grams"], p["g"])), of_hits)

    reached = F.array_sort(F.filter(F.flatten(F.transform("asked", of_template)), lambda w: w["d"] <= -threshold))
    met = once(met, "reached", reached).where(F.size("reached") > 0)
    common = lambda v, w: F.least(v["b"], w["b"]) - F.greatest(v["a"], w["a"]) + 1
    length = lambda v: v["b"] - v["a"] + 1
    beaten = lambda v, w: (common(v, w) > 0) & ((v["license"] == w["license"]) | ((2 * common(v, w) > F.least(length(v), length(w))) & (2 * F.least(v["n"], w["n"]) > F.greatest(v["n"], w["n"]))))
    none = F.filter("reached", lambda w: F.lit(False))
    kept = F.aggregate("reached", none, lambda acc, w: F.when(F.exists(acc, lambda v: beaten(v, w)), acc).otherwise(F.concat(acc, F.array(w))))
    blank = lambda i: (i < 0) | (i >= F.size("lines")) | (F.trim(F.get("lines", i)) == "")
    inner = lambda w: F.exists(F.slice("lines", w["a"] + 1, length(w)), lambda x: F.trim(x) == "")
    outer = lambda w: F.exists(F.slice("lines", 1, w["a"]), lambda x: F.trim(x) != "") | F.exists(F.slice("lines", w["b"] + 2, F.size("lines")), lambda x: F.trim(x) != "")
    other = lambda w: (w["a"] < w["b"]) & outer(w) & (inner(w) | ~blank(w["a"] - 1) | ~blank(w["b"] + 1))
    found = met.select("doc_id", F.explode(F.filter(kept, other)).alias("w"))
    return found.select("doc_id", F.lit("window").alias("piece"), F.col("w.a").cast("bigint").alias("first_line"), F.col("w.n").cast("bigint").alias("n_bigrams"), F.col("w.license").alias("license"), (-F.col("w.d")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, piece ('line', 'paragraph', 'text' or 'window'), first_line (its number, from 0),
    n_bigrams, license, dice of every piece that reaches the threshold and of the best windows."""
    num, rest = _share(threshold)
    known = [{"license": k, "grams": bigrams_of(v), "n": len(bigrams_of(v))} for k, v in sorted(templates.items())]
    least, most = -(-num * min(t["n"] for t in known) // rest), rest * max(t["n"] for t in known) // num
    table = F.from_json(F.lit(json.dumps(known)), "array<struct<license:string,grams:array<string>,n:int>>")
    words = F.array(*(F.lit(w) for w in anchors(templates, threshold)))
    plain = once(docs.select("doc_id", F.col("text").cast("string").alias("text")), "norm", F.regexp_replace(F.lower("text"), _KEPT, " ")).drop("text")
    plain = plain.where(F.arrays_overlap(F.split("norm", "[ \n]+", -1), words))
    plain = once(plain, "lines", F.split("norm", "\n", -1))
    windows = _windows(plain.where(F.size("lines") > 1), known, threshold)
    kind = "array<struct<piece:string,first_line:bigint,text:string>>"
    piece = lambda name, at, text: F.struct(F.lit(name).alias("piece"), at.cast("bigint").alias("first_line"), text.alias("text"))
    filled = lambda i: F.trim(F.element_at("lines", i + 1)) != ""
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: filled(i) & ((i == 0) | ~filled(F.greatest(i - 1, F.lit(0)))))
    paragraphs = F.filter(F.split("norm", r"\n *(?:\n *)+", -1), lambda t: F.regexp_replace(t, "[ \n]+", "") != "")
    plain = once(once(plain, "starts", starts), "filled", paragraphs)
    pieces = plain.select("doc_id", F.explode(F.concat(
        F.transform("lines", lambda t, i: piece("line", i, t)),
        F.when(F.size("filled") > 1, F.transform("filled", lambda t, i: piece("paragraph", F.element_at("starts", i + 1), t))).otherwise(F.array().cast(kind)),
        F.when(F.size("lines") > 1, F.array(piece("text", F.lit(0), F.col("norm")))).otherwise(F.array().cast(kind)),
    )).alias("p")).select("doc_id", "p.*")
    pieces = once(pieces, "words", F.filter(F.split("text", "[ \n]+", -1), lambda w: w != "")).drop("text")
    pieces = once(pieces.where(F.arrays_overlap("words", words) & (F.size("words") > least)), "grams", _bigrams(F.col("words"))).drop("words")
    n = F.size("grams")
    near = F.filter(table, lambda t: (n * rest >= t["n"] * num) & (n * num <= t["n"] * rest))
    dice = lambda t: F.round(2.0 * F.size(F.array_intersect("grams", t["grams"])) / (n + t["n"]), 6)
    best = F.array_min(F.transform(near, lambda t: F.struct((-dice(t)).alias("d"), t["license"].alias("license"))))
    found = once(pieces.where(n.between(least, most)), "best", best)
    found = found.where(F.col("best.d") <= -threshold).select("doc_id", "piece", "first_line", F.size("grams").cast("bigint").alias("n_bigrams"), F.col("best.license").alias("license"), (-F.col("best.d")).alias("dice"))
    return found.unionAll(windows)


def duckdb_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan without anchors and size bounds, for comparison."""
    rows = ", ".join(f"('{k}', [{', '.join(chr(39) + g + chr(39) for g in bigrams_of(v))}])" for k, v in sorted(templates.items()))
    return f"""
    WITH t(license, grams) AS (VALUES {rows}),
    n AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS norm FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, norm, string_split(norm, chr(10)) AS lines FROM n),
    u AS (
      SELECT doc_id, 'line' AS piece, i AS pos, lines[i + 1] AS x FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l)
      UNION ALL SELECT doc_id, 'text', 0, norm FROM l WHERE len(lines) > 1
      UNION ALL SELECT doc_id, 'paragraph', min(i), string_agg(line, chr(10) ORDER BY i) FROM (
        SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp, count(*) FILTER (WHERE first) OVER (PARTITION BY doc_id) AS np FROM (
          SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM i - 1 AS first FROM (
            SELECT doc_id, i, lines[i + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS i FROM l)) WHERE trim(line) <> '')) WHERE np > 1 GROUP BY doc_id, grp
    ),
    w AS (SELECT *, list_filter(regexp_split_to_array(x, '[ \\n]+'), lambda z: z <> '') AS ws FROM u),
    g AS (SELECT doc_id, piece, pos, list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS grams FROM w WHERE len(ws) > 1),
    d AS (SELECT g.doc_id, g.piece, g.pos, CAST(len(g.grams) AS BIGINT) AS n_bigrams, t.license, round(2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)), 6) AS dice FROM g, t)
    SELECT doc_id, piece, CAST(pos AS BIGINT) AS first_line, n_bigrams, license, dice FROM d WHERE dice >= {threshold}
    QUALIFY row_number() OVER (PARTITION BY doc_id, piece, pos ORDER BY dice DESC, license) = 1"""

"""Licence scan with DataFrame functions only.

A text is normalised once to lower-case words, whatever its lines, comment marks
and punctuation, and its word bigrams are compared to those of licence templates
by the Dice coefficient, repeats included. A template meets the *window* of the
text that is most like it, wherever it stands: inside a line, across lines, or
the whole text.

Size bounds prune. A Dice coefficient of t needs sizes within a factor of
t / (2 - t), so a template of m bigrams

* has no match in a text of fewer than m t / (2 - t) bigrams,
* meets windows of m t / (2 - t) to m (2 - t) / t bigrams only,
* shares at least t m / (2 - t) bigrams with a match. So a match holds one of any
  m - that many + 1 of its bigrams (its *probes* are such a set), and it starts where that many
  bigrams of the template stand close enough together.

A few *marker* words are chosen that are in at least so many probes of every
template: a text without any is gone before it is cut into words, one without a
probe after one hash lookup per bigram. The others meet their templates by an
equi-join on the probe; everything else happens row by row
on arrays: no shuffle, and no group of rows ever meets in one task. Templates
are a stated query set: a large table is taken in blocks of ``BLOCK_CHARS``
characters, one after the other.

How a window is counted exactly: a bigram that the template has c times counts
where its c-th last occurrence before lies outside of the window. So the shared
bigrams of all windows with one start come from one pass.

Edge cases: null and empty texts and texts of one word have no bigram and match
nothing; of equally similar windows the first, then the shortest is reported, so
a document row has one row per template at most; repeated rows and equally
similar templates are reported each; a template of one word or none matches
nothing; an empty table on either side gives an empty result; extra columns do
no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, union_all

THRESHOLD = 0.8
#: Characters of one block of templates: what the driver holds and broadcasts at a time.
BLOCK_CHARS = 200_000
#: Letters of a marker word that is taken before shorter ones.
MARKER = 6
MATCHES = "doc_id long, segment string, template int, license string, dice double, start long"

#: Licence statements and notices (identifier, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i + 1, k, t) for i, (k, t) in enumerate(TEMPLATES)], "template int, license string, text string")


def normalised(text: Column) -> Column:
    """Lower-case words (letters and digits), single-spaced."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, repeats included."""
    return F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda x, i: F.concat_ws(" ", F.get(words, i), x))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: a plain projection would be repeated inside every filter and function that uses it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def prepared(templates: DataFrame, threshold: float) -> DataFrame:
    """template, license, own (distinct bigrams), times, m, least, low, high, probes of every template that has bigrams."""
    near = threshold / (2 - threshold)
    t = _once(templates.select("template", "license", "text"), "w", F.split(normalised(F.col("text")), " "))
    t = _once(t, "all", bigrams(F.col("w"))).withColumn("m", F.size("all")).filter("m > 0")
    t = _once(t, "own", F.array_distinct("all"))
    t = _once(t, "times", F.transform("own", lambda x: F.size(F.filter("all", lambda y: y == x))))
    t = t.withColumns({
        "low": F.ceil(F.col("m") * near - 1e-9).cast("int"), "high": F.floor(F.col("m") / near + 1e-9).cast("int"),
        "least": F.ceil(F.col("m") * (threshold / 2 * (1 + near)) - 1e-9).cast("int"),
    })
    return t.select("template", "license", "own", "times", "m", "least", "low", "high")


def markers(rows: list) -> list[str]:
    """Few words such that every match with one of the templates ``rows`` holds a bigram with one of them.

    m - least + 1 of a template's bigrams can't all be missing from a match, so
    words that so many of its bigrams contain will do. Greedy: the word that
    brings all templates furthest comes next; short words are last resorts.
    """
    need = [r["m"] - r["least"] + 1 for r in rows]
    left = [dict(zip(r["own"], r["times"], strict=True)) for r in rows]
    words = sorted({w for r in rows for x in r["own"] for w in x.split(" ")}, key=lambda w: (-len(w), w))
    out: list[str] = []
    while any(n > 0 for n in need):
        gain = {w: sum(min(n, sum(c for x, c in own.items() if w in x)) for n, own in zip(need, left, strict=True) if n > 0) for w in words}
        best = max(words, key=lambda w: (gain[w] * (len(w) >= MARKER), gain[w]))
        out.append(best)
        need = [n - sum(c for x, c in own.items() if best in x) for n, own in zip(need, left, strict=True)]
        left = [{x: c for x, c in own.items() if best not in x} for own in left]
    return out


def _best(threshold: float) -> Column:
    """(dice, -start, -length) of the most similar window, from ``hits`` (where bigrams of the template stand) of a row."""
    hits, m, high = F.col("hits"), F.col("m"), F.col("high")

    def start(a: Column, j: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            n = b["at"] - a["at"] + 1
            shared = acc["shared"] + F.when(b["before"] < a["at"], 1).otherwise(0)
            dice = F.when((n >= F.col("low")) & (n <= high), 2 * shared / (m + n)).otherwise(-1.0)
            new = F.struct(dice.alias("dice"), (-a["at"]).alias("start"), (-n).alias("length"))
            return F.struct(shared.alias("shared"), F.greatest(acc["best"], new).alias("best"))

        none = F.struct(F.lit(-1.0).alias("dice"), F.lit(0).alias("start"), F.lit(0).alias("length"))
        return F.aggregate(F.slice(hits, j + 1, high), F.struct(F.lit(0).alias("shared"), none.alias("best")), step, lambda acc: acc["best"])

    # a window starts where `least` hits stand within the largest size
    starts = F.filter(F.transform(hits, lambda a, j: F.struct(a.alias("a"), j.alias("j"))), lambda s: F.get(hits, s["j"] + F.col("least") - 1)["at"] - s["a"]["at"] < high)
    return F.array_max(F.transform(starts, lambda s: start(s["a"], s["j"])))


def _with_hits(rows: DataFrame) -> DataFrame:
    """Add ``hits``: (at, k, before) of every bigram that the template has; before: where its c-th last occurrence stands."""
    found = F.filter(F.transform("known", lambda s: F.struct(s["at"].alias("at"), F.array_position("own", s["x"]).cast("int").alias("k"))), lambda s: s["k"] > 0)
    rows = _once(rows, "found", found).filter(F.size("found") >= F.col("least"))
    # exact, and cheap: `least` hits within the largest size, or no window can do
    rows = rows.filter(F.exists(F.transform("found", lambda a, j: F.get("found", j + F.col("least") - 1)["at"] - a["at"] < F.col("high")), lambda x: x))

    def before(a: Column, j: Column) -> Column:
        # occurrences further back than the largest size are outside of every window
        back = F.least(j, F.col("high"))
        same = F.filter(F.slice("found", j - back + 1, back), lambda s: s["k"] == a["k"])
        c = F.get("times", a["k"] - 1)
        return F.struct(a["at"].alias("at"), F.coalesce(F.get(same, F.size(same) - c)["at"], F.lit(-1)).alias("before"))

    return _once(rows, "hits", F.transform("found", before)).drop("found")


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, segment (normalised words of the window), template, license, dice, start (word number) of every match."""
    spark = docs.sparkSession
    t = default_templates(spark) if templates is None else templates
    n = max(1, -(-(t.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))  # one number
    block = lambda k: t if n == 1 else t.filter(F.pmod(F.xxhash64("template", "license"), F.lit(n)) == k)
    return union_all([_scan_block(docs, prepared(block(k), threshold), threshold) for k in range(n)])


def _scan_block(docs: DataFrame, t: DataFrame, threshold: float) -> DataFrame:
    found = t.collect()  # bounded: one block
    marks = markers(found)
    probes = [[x for x in r["own"] if any(w in x for w in marks)] for r in found]
    t = docs.sparkSession.createDataFrame([(*r, p) for r, p in zip(found, probes, strict=True)], t.withColumn("probes", F.col("own")).schema)
    every = sorted({x for p in probes for x in p})
    if not every:
        return docs.sparkSession.createDataFrame([], MATCHES)
    rows = _once(only(docs, "doc_id", "text").filter("text IS NOT NULL"), "lower", F.lower("text")).drop("text")
    rows = rows.filter(reduce(Column.__or__, [F.contains("lower", F.lit(w)) for w in marks]))
    rows = _once(rows, "w", F.split(normalised(F.col("lower")), " ")).drop("lower")
    rows = _once(rows, "pairs", bigrams(F.col("w")))
    rows = _once(rows, "seen", F.array_distinct(F.filter("pairs", lambda x: x.isin(every)))).filter(F.size("seen") > 0)
    # where bigrams of any template stand, by one hash lookup each
    own = sorted({x for r in found for x in r["own"]})
    rows = _once(rows, "known", F.filter(F.transform("pairs", lambda x, i: F.struct(i.alias("at"), x.alias("x"))), lambda s: s["x"].isin(own))).withColumn("size", F.size("pairs")).drop("pairs")
    met = rows.select("*", F.explode("seen").alias("probe")).join(F.broadcast(t.withColumn("probe", F.explode("probes"))), "probe")
    # a row meets a template once: by the first of its probes that it has
    met = met.filter((F.get(F.filter("probes", lambda x: F.array_contains("seen", x)), F.lit(0)) == F.col("probe")) & (F.col("size") >= F.col("low")))
    best = _once(_with_hits(met), "best", _best(threshold)).filter(F.col("best.dice") >= threshold)
    start, n = -F.col("best.start"), -F.col("best.length")
    return best.select("doc_id", F.array_join(F.slice("w", start + 1, n + 1), " ").alias("segment"), "template", "license", F.col("best.dice").alias("dice"), start.cast("long").alias("start"))

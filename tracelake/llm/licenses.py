"""Licence scans by the Dice coefficient over word bigrams, in DataFrame functions alone.

Every line of a text, and the text as a whole, is normalised (lowered; anything but letters and digits is a space) and
compared with licence templates: 2 * |A and B| / (|A| + |B|) over the sets of word bigrams. A unit of n bigrams can only
reach t with templates of between n * t / (2 - t) and n * (2 - t) / t bigrams; units outside of all bounds are dropped
before their bigrams are made, and templates outside are dropped in the join. Only bigrams that some template has
go on. Each unit counts for its best template (on ties the first licence name). Texts without any of the words that every
match must have (``anchors``) are skipped before anything is made of them.

Notices inside of a line, and texts wrapped over several lines, are found by windows of all lengths up to the template's times
(2 - t) / t: from each place with a bigram of the template the best window is a unit too, unless a matching line covers it or the
whole text matched. Windows that overlap are one unit, with the best score. What is inserted, dropped or changed inside a licence
costs no more than it costs the coefficient.

Defined results: null and empty texts give no rows; very long texts are compared whole, and their words have to fit a task; a unit of one word has no bigrams and matches nothing; rows that share
an id are counted together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.shared import spent, written

THRESHOLD = 0.8
#: Words of a text at which windows start in one piece.
STEP = 4096
#: Stands for a matching line among the words of a text; no normalised word looks like it.
BARRIER = "-"

# Public names of licences, and the usual forms of a notice.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "EPL-2.0": ("Eclipse Public License, version 2.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL v3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "Zlib": ("zlib License",),
}
FORMS = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This work is licensed under the {}", "This work is licensed under a {}", "This file is licensed under the {}", "This software is released under the {}")
TEXTS = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WARRANTY = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
# Whole texts, without the lines that name the holder.
WHOLE = {
    "Apache-2.0": TEXTS["Apache-2.0"] + ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": f"{_BSD} {_AS_IS} {_WARRANTY}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS} {_WARRANTY}",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": TEXTS["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT": TEXTS["MIT"] + ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense": TEXTS["Unlicense"] + ' Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates."""
    made = [(name, form.format(title)) for name, titles in NAMES.items() for title in titles for form in FORMS]
    return sorted({*made, *TEXTS.items(), *WHOLE.items()})


def anchors(given: list[tuple[str, str]], threshold: float) -> list[str] | None:
    """Words of which every unit that reaches the threshold with some template has at least one.

    Such a unit shares at least a * t / (2 - t) of the template's a bigrams. So it is enough that more of the template's bigrams
    have an anchor than may be missing. Words are added, those of most templates first and short ones last, until that
    holds for all. None if a template is not plain ASCII: then no text is skipped.
    """
    if not all(text.isascii() for _, text in given):
        return None
    pairs = []
    for _, text in given:
        parts = re.split("[^a-z0-9]+", text.lower())
        parts = [x for x in parts if x]
        own = sorted(set(zip(parts[:-1], parts[1:], strict=True)))
        pairs.append((own, len(own) - math.ceil(len(own) * threshold / (2 - threshold) - 1e-9)))
    chosen: list[str] = []
    while open_ := [own for own, spare in pairs if own and sum(any(w in chosen for w in g) for g in own) <= spare]:
        votes = Counter(w for own in open_ for w in {w for g in own for w in g} if w not in chosen)
        chosen.append(max(sorted(votes), key=lambda w: (len(w) >= 6, votes[w])))
    return [w for w in chosen if not any(x in w for x in chosen if x != w)]


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\n]+", " ")


def _in_order(parts: F.Column) -> F.Column:
    """The bigrams of a list of words, with repeats."""
    return F.zip_with(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 2, F.size(parts)), lambda a, b: F.concat(a, F.lit(" "), b))


def bigrams(parts: F.Column) -> F.Column:
    """The set of bigrams of a list of words."""
    return F.array_distinct(_in_order(parts))


def template_words(spark: SparkSession, given: list[tuple[str, str]]) -> DataFrame:
    """(template, license, words, grams, size): a row per template; fixed in size by the list."""
    quoted = ", ".join("({}, {}, {})".format(k, *("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in row)) for k, row in enumerate(given))
    rows = spark.sql(f"SELECT * FROM VALUES {quoted} AS t(template, license, text)")
    words = F.split(F.trim(F.regexp_replace(normalised(F.col("text")), "\\s+", " ")), " ")
    return rows.select("template", "license", words.alias("words")).withColumn("grams", bigrams(F.col("words"))).withColumn("size", F.size("grams"))


def _units(texts: DataFrame, given: DataFrame, threshold: float) -> DataFrame:
    """(id, row, place, license, dice) of the lines of (id, row, text), and of whole texts as their last line, that reach the threshold."""
    low, high = given.agg(F.min("size"), F.max("size")).first()
    # a little wider than exact, as rounding must not cut what just reaches the threshold
    least, most = threshold / (2 - threshold) * (1 - 1e-9), (2 - threshold) / threshold * (1 + 1e-9)
    whole = F.when(F.contains("text", F.lit("\n")), F.array(F.translate("text", "\n", " "))).otherwise(F.array().cast("array<string>"))
    rows = texts.select("id", "row", F.posexplode(F.concat(F.split("text", "\n"), whole)).alias("place", "unit"))
    # n words have at most n - 1 bigrams, and at least one less than there are distinct words
    rows = rows.withColumn("unit", F.trim(F.regexp_replace("unit", " +", " "))).withColumn("parts", F.split("unit", " "))
    rows = rows.filter((F.size("parts") - 1 >= F.lit(max(1, low * least))) & (F.size(F.array_distinct("parts")) - 1 <= F.lit(high * most)))
    rows = rows.withColumn("grams", bigrams(F.col("parts"))).withColumn("n", F.size("grams")).filter((F.col("n") >= low * least) & (F.col("n") <= high * most))
    parts = rows.select("id", "row", "place", "n", F.explode("grams").alias("bigram"))
    table = given.select("template", "license", "size", F.explode("grams").alias("bigram"))
    hits = parts.join(F.broadcast(table), "bigram").filter((F.col("size") >= F.col("n") * least) & (F.col("size") <= F.col("n") * most))
    dice = hits.groupBy("row", "place", "template").agg(F.first("id").alias("id"), F.first("license").alias("license"), (F.count(F.lit(1)) * 2.0 / (F.first("n") + F.first("size"))).alias("dice"))
    good = dice.filter(F.col("dice") >= threshold)
    return good.groupBy("row", "place").agg(F.first("id").alias("id"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"), F.max("dice").alias("dice"))


def _windows(texts: DataFrame, matched: DataFrame, given: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, license, dice) of the windows of words, in what no matching line covers, that reach the threshold; of windows that overlap the best.

    A window begins with a bigram of the template and has at most ``span`` bigrams: the template's length times (2 - t) / t. It needs ``need`` of the
    template's bigrams, so only places with so many of them within a span ahead are starts. From a start the window grows from one of the
    template's bigrams to the next, with a running count of distinct bigrams and of the template's, and the best end counts. Texts are cut into pieces of STEP starts, each with the
    words of a span more; the table of these is the second result.
    """
    lines = F.split("text", "\n")
    taken = matched.groupBy(F.col("row").alias("r")).agg(F.collect_set("place").alias("taken"))
    open_ = texts.join(taken, F.col("row") == F.col("r"), "left").filter(F.coalesce(~F.array_contains("taken", F.size(lines)), F.lit(True)))  # no whole text
    rest = F.transform(lines, lambda x, k: F.when(F.coalesce(F.array_contains("taken", k), F.lit(False)), F.lit(BARRIER)).otherwise(x))
    words = F.split(F.trim(F.regexp_replace(F.array_join(rest, " "), " +", " ")), " ")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    bounds = given.withColumn("need", F.ceil(F.col("size") * low - 1e-9).cast("int")).withColumn("span", F.floor((F.size("words") - 1) * high + 1e-9).cast("int"))
    tail = bounds.agg(F.max("span")).first()[0]
    open_ = open_.select("id", "row", words.alias("words")).filter(F.size("words") > 1)
    cut = F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - 1, F.lit(STEP)), lambda at: F.slice("words", at, STEP + tail)))
    open_ = written(open_.select("id", "row", cut.alias("piece", "words")), "license-texts")
    pairs = open_.select("row", "piece", F.posexplode(_in_order(F.col("words"))).alias("at", "bigram"))
    hits = pairs.join(F.broadcast(bounds.select("template", "need", "span", F.posexplode("grams").alias("o", "bigram"))), "bigram")
    found = hits.groupBy("row", "piece", "template").agg(F.first("need").alias("need"), F.first("span").alias("span"), F.size(F.collect_set("o")).alias("m"), F.sort_array(F.collect_list("at")).alias("at")).filter("m >= need")
    dense = F.filter(F.sequence(F.lit(1), F.size("at") - F.col("need") + 1), lambda k: (F.element_at("at", k + F.col("need") - 1) - F.element_at("at", k) < F.col("span")) & (F.element_at("at", k) < STEP))
    starts = F.transform(dense, lambda k: F.struct(F.element_at("at", k).alias("start"), F.filter(F.slice("at", k, F.col("span")), lambda x: x < F.element_at("at", k) + F.col("span")).alias("hits")))
    found = found.select("row", "piece", F.struct("template", "span", starts.alias("starts")).alias("x")).filter(F.size("x.starts") > 0).groupBy("row", "piece").agg(F.collect_list("x").alias("x"))
    # places of bigrams that came before, with the place where they did last
    placed = F.array_sort(F.transform(_in_order(F.col("words")), lambda x, k: F.struct(x.alias("bigram"), k.alias("at"))))
    again = F.filter(F.zip_with("placed", F.slice("placed", 2, F.size("placed")), lambda x, y: F.struct(F.when(x["bigram"] == y["bigram"], y["at"]).alias("at"), x["at"].alias("last"))), lambda x: x["at"].isNotNull())
    seen = open_.join(found, ["row", "piece"]).select("id", "row", "piece", "x", placed.alias("placed")).select("id", "row", "piece", "x", again.alias("again"))

    def window(x: F.Column, own: F.Column) -> F.Column:
        start = own["start"]
        repeats = F.transform(F.filter("again", lambda y: (y["last"] >= start) & (y["at"] < start + x["span"])), lambda y: y["at"])
        return F.struct(x["template"].alias("template"), start.alias("start"), own["hits"].alias("hits"), repeats.alias("repeats"))

    grown = seen.select("id", "row", "piece", F.explode(F.flatten(F.transform("x", lambda x: F.transform(x["starts"], lambda own: window(x, own))))).alias("w")).select("id", "row", "piece", "w.*")
    grown = grown.join(F.broadcast(given.select("template", "license", "size")), "template")
    none = F.struct(F.lit(0).alias("m"), F.lit(0.0).alias("dice"), F.lit(0).alias("stop"))

    def grow(so_far: F.Column, hit: F.Column) -> F.Column:
        m = so_far["m"] + (~F.array_contains("repeats", hit)).cast("int")
        dice = m * 2.0 / (hit - F.col("start") + 1 - F.size(F.filter("repeats", lambda x: x <= hit)) + F.col("size"))
        better = dice > so_far["dice"]
        return F.struct(m.alias("m"), F.when(better, dice).otherwise(so_far["dice"]).alias("dice"), F.when(better, hit).otherwise(so_far["stop"]).alias("stop"))

    grown = grown.select("id", "row", "piece", "template", "license", "start", F.explode(F.array(F.aggregate("hits", none, grow))).alias("best"))  # explode, so that the filter does not grow it again
    base = F.col("piece") * STEP
    best = grown.select("id", "row", "template", "license", (base + F.col("start")).alias("start"), (base + F.col("best.stop") + 2).alias("stop"), "best.dice")
    good = best.filter(F.col("dice") >= threshold)
    order = Window.partitionBy("row").orderBy("start", "stop", "template")
    reached = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = good.withColumn("new", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    return islands.groupBy("row", "island").agg(F.first("id").alias("id"), F.min_by("license", F.struct(-F.col("dice"), "license")).alias("license"), F.max("dice").alias("dice")).select("id", "license", "dice"), open_


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, given: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document and licence: id, license, score (the best Dice coefficient), units (how many lines, whole texts and windows matched)."""
    listed = templates() if given is None else given
    table = template_words(docs.sparkSession, listed).filter("size > 0")
    if table.isEmpty():
        return docs.select(F.col(id_col), F.lit("").alias("license"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("units")).limit(0)
    words = anchors(listed, threshold)
    if words is not None:
        lowered = F.lower(F.col(text_col).cast("string"))
        # an array of one, so that a text is lowered once and not for every word
        docs = docs.filter(F.exists(F.array(lowered), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words])))
    text = normalised(F.col(text_col).cast("string"))
    texts = written(docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("text")), "license-candidates")
    units = written(_units(texts, table, threshold), "license-lines")
    windows, cut = _windows(texts, units, table, threshold)
    found = units.select("id", "license", "dice").unionByName(windows)
    out = written(found.groupBy(F.col("id").alias(id_col), "license").agg(F.max("dice").alias("score"), F.count(F.lit(1)).alias("units")), "licenses")
    spent(texts, units, cut)
    return out

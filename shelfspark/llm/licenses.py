"""Licence scans: lines, whole texts and blocks of words compared to licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, looked_up, table, words_of

#: Licence notices as their licensors word them.
TEMPLATES = {
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/short": "Released under the MIT License.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC/text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "LGPL-2.1/notice": 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.',
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
THRESHOLD = 0.8


#: Words that stand in any text: a sign of a template is rather another word.
_COMMON = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "with", "you")


def _words(template: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", template.lower()) if w]


def _need(bigrams: int, threshold: float) -> int:
    """Distinct bigrams of a template that a unit has to share."""
    return math.ceil(bigrams * threshold / (2 - threshold) - 1e-9)


def _signs(template: str, threshold: float) -> set[str]:
    """Words of which a text has at least one if any part of it reaches the threshold: without them too few bigrams can be shared."""
    words = _words(template)
    pairs, signs = set(zip(words, words[1:], strict=False)), set()
    need, rest = _need(len(pairs), threshold), sorted(set(words), key=lambda w: (w in _COMMON, -len(w), w))
    while rest and len(pairs) >= need:
        signs.add(rest.pop(0))
        pairs = {p for p in pairs if not signs & set(p)}
    return signs


def _hits(docs: DataFrame, known: DataFrame, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(doc_id, _m, licence, template_bigrams, _need, _span, _h) with _h the sorted array(struct(i, a, b, x)) of the template's bigrams in a text.

    Texts without a sign of a template go first. Of the others only positions whose two words are words of templates leave
    the row, so what is joined, shuffled and gathered follows the hits, not the texts. a and b are the lines of a bigram's words.
    """
    signs, vocabulary = sorted(set().union(*(_signs(t, threshold) for t in templates.values()))), sorted({w for t in templates.values() for w in _words(t)})
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_m"), "text").where(F.arrays_overlap(words_of(F.col("text")), F.array(*map(F.lit, signs))))
    both = lambda w, i: F.get(w, i).isin(*vocabulary) & F.get(w, i + 1).isin(*vocabulary)
    at = lambda s, i: F.struct(i.alias("i"), F.get(s["n"], i).alias("a"), F.get(s["n"], i + 1).alias("b"), F.concat_ws(" ", F.get(s["w"], i), F.get(s["w"], i + 1)).alias("x"))
    found = lambda s: F.when(F.size(s["w"]) > 1, F.transform(F.filter(F.sequence(F.lit(0), F.size(s["w"]) - 2), lambda i: both(s["w"], i)), lambda i: at(s, i)))
    rows = rows.select("doc_id", "_m", F.explode(let(_lined(F.col("text")), found)).alias("p"))
    rows = rows.select("doc_id", "_m", "p", F.col("p.x").alias("_x")).join(F.broadcast(known), "_x")
    rows = rows.groupBy("doc_id", "_m", "licence", "template_bigrams", "_need", "_span").agg(F.array_sort(F.collect_set("p")).alias("_h"))
    return rows.where(F.size(F.array_distinct("_h.x")) >= F.col("_need"))


def _lined(text: Column) -> Column:
    """struct(l, w, n): the words of each line, all of them, and the line from 1 of each."""
    line = lambda l: F.flatten(F.transform(l, lambda w, i: F.array_repeat(i + 1, F.size(w))))
    return let(F.transform(F.split(text, "\n"), words_of), lambda l: F.struct(l.alias("l"), F.flatten(l).alias("w"), line(l).alias("n")))


def _pairs(w: Column) -> Column:
    """Word pairs in their order; a single word has none."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(F.size(w) > 1, many).otherwise(F.array().cast("array<string>"))


def _tried(hits: DataFrame) -> DataFrame:
    """(doc_id, _m, licence, template_bigrams, line, s, e, shared) of the units and blocks that share enough bigrams.

    line is 0 for the whole text, a number for a line, null for a block from bigram s to e. A block begins and ends with a
    run of the template's bigrams, since a bigram more that is shared only helps; it is shorter than the template's span,
    or one run.
    """
    whole = hits.select("*", F.lit(0).alias("line"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.size(F.array_distinct("_h.x")).alias("shared"))
    own = F.filter("_h", lambda p: p["a"] == p["b"])
    lines = hits.select("doc_id", "_m", "licence", "template_bigrams", "_need", F.explode(own).alias("p")).groupBy("doc_id", "_m", "licence", "template_bigrams", "_need", F.col("p.a").alias("line"))
    lines = lines.agg(F.countDistinct("p.x").cast("int").alias("shared")).where("shared >= _need").withColumns({"s": F.lit(0), "e": F.lit(0)})
    first = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda k: (k == 0) | (F.get("_h", k)["i"] != F.get("_h", k - 1)["i"] + 1))
    last = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda k: (k == F.size("_h") - 1) | (F.get("_h", k + 1)["i"] != F.get("_h", k)["i"] + 1))
    width = lambda j, k: F.get("_h", k)["i"] - F.get("_h", j)["i"]
    fits = lambda j, k: (k >= j + F.col("_need") - 1) & ((width(j, k) < F.col("_span")) | (width(j, k) == k - j))
    held = lambda j, k: F.size(F.array_distinct(F.transform(F.slice("_h", j + 1, k - j + 1), lambda p: p["x"])))
    block = lambda j, k: F.struct(F.get("_h", j)["i"].alias("s"), F.get("_h", k)["i"].alias("e"), held(j, k).alias("shared"))
    spans = hits.withColumn("_f", first).withColumn("_e", last).withColumn("j", F.explode("_f")).withColumn("k", F.explode(F.filter("_e", lambda k: fits(F.col("j"), k))))
    blocks = spans.withColumn("b", block(F.col("j"), F.col("k"))).where("b.shared >= _need")
    columns = ["doc_id", "_m", "licence", "template_bigrams", "line", "s", "e", "shared"]
    return whole.select(columns).unionByName(lines.select(columns)).unionByName(blocks.select("doc_id", "_m", "licence", "template_bigrams", F.lit(None).cast("int").alias("line"), "b.s", "b.e", "b.shared"))


def licence_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, licence, shared, line_bigrams, template_bigrams, dice) of the best template of each unit.

    docs: doc_id, text; other columns are not read. Units are the whole text (line_no 0) and, if it has several,
    its lines from 1. Words are lower-case runs of letters and digits. Dice is 2 * shared / (own + template) over
    distinct bigrams; units of at least `threshold` are returned, with the best template, ties to the first name.
    A template can reach the threshold only in units with t/(2-t) of its own bigrams, so others are not compared.
    Null, empty and one-word units match nothing; repeated rows are reported once, rows without doc_id too; an empty
    table gives no rows. The templates are constants of the plan, so their bigrams are broadcast.

    Blocks of words within or across lines are compared too, so a notice wrapped over lines of a longer text or inside
    a paragraph is found; line_no is the line where the block begins, from 1. Of blocks that overlap the one that
    shares most stays, then the one of greater Dice; a block that shares no more than a matched unit it touches is not
    repeated. So a line may have a row as a unit and rows as the begin of blocks.

    The first pass finds where the templates' bigrams stand, the second one reads only texts with enough of them again
    and measures the units and blocks there.
    """
    spark = docs.sparkSession
    of = {k: set(zip(_words(t), _words(t)[1:], strict=False)) for k, t in templates.items()}
    wide = {k: max(2, math.floor((len(_words(t)) - 1) * (2 - threshold) / threshold + 1e-9)) for k, t in templates.items()}
    rows = [(k, " ".join(x), len(p), _need(len(p), threshold), wide[k]) for k, p in sorted(of.items()) for x in sorted(p)]
    known = spark.createDataFrame(rows, "licence string, _x string, template_bigrams int, _need int, _span int")
    tried = cut(_tried(cut(_hits(docs, known, templates, threshold), "hits")), "tried")

    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_m"), "text")
    wanted = tried.groupBy("doc_id", "_m").agg(F.collect_list(F.struct("licence", "template_bigrams", "line", "s", "e", "shared")).alias("_c"))
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t._m") == F.col("c._m"))
    texts = looked_up(texts, "_m", cut(wanted.select("_m").distinct(), "held"), 40, "left_semi")
    texts = texts.alias("t").join(wanted.alias("c"), same).select("t.doc_id", "t._m", "t.text", "c._c")
    distinct = lambda w: F.size(F.array_distinct(_pairs(w)))
    size = lambda s, c: F.when(c["line"] == 0, distinct(s["w"])).when(c["line"] > 0, distinct(F.get(s["l"], c["line"] - 1))).otherwise(distinct(F.slice(s["w"], c["s"] + 1, c["e"] - c["s"] + 2)))
    measured = lambda s: F.transform("_c", lambda c: F.struct(*[c[x].alias(x) for x in ("licence", "template_bigrams", "line", "s", "e", "shared")], size(s, c).alias("line_bigrams"), F.get(s["n"], c["s"]).alias("from"), F.get(s["n"], c["e"] + 1).alias("to"), (F.size(s["l"]) > 1).alias("several")))
    units = texts.select("doc_id", "_m", F.explode(let(_lined(F.col("text")), measured)).alias("u")).select("doc_id", "_m", "u.*").distinct()
    units = units.withColumn("dice", F.lit(2.0) * F.col("shared") / (F.col("line_bigrams") + F.col("template_bigrams"))).where(F.col("dice") >= threshold)
    units = cut(units, "units")
    told = F.struct((-F.col("dice")).alias("d"), "licence", "shared", "line_bigrams", "template_bigrams", "dice")
    best = units.where("line = 0 or line > 0 and several").groupBy("doc_id", "_m", F.col("line").alias("line_no")).agg(F.min(told).alias("_r"))
    best = best.unionByName(_blocks(units.where("line is null"), best))
    long = [F.col(f"_r.{c}").cast("long").alias(c) for c in ("shared", "line_bigrams", "template_bigrams")]
    return best.select("doc_id", F.col("line_no").cast("long"), "_r.licence", *long, "_r.dice").distinct()


def templates_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """Templates for licence_matches() from a folder of licence texts: a file's name is the licence's, equal texts count once, by
    the first name. Meant for a few dozen whole texts, which become constants of the plan; a folder without files has none."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    texts: dict[str, str] = {}
    for r in sorted(files):
        texts.setdefault(r["value"], f"{r['name']}/text")
    return {name: text for text, name in texts.items() if len(_words(text)) > 1}


def _blocks(tried: DataFrame, best: DataFrame) -> DataFrame:
    """The blocks of licence_matches(), with columns like those of `best`, the matches of whole units."""
    matched = best.groupBy("doc_id", "_m").agg(F.collect_list(F.struct("line_no", F.col("_r.shared").alias("shared"))).alias("_told"))
    same = F.col("b.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("b._m") == F.col("k._m"))
    rows = tried.alias("b").join(matched.alias("k"), same, "left").select("b.*", "k._told")
    said = F.exists("_told", lambda u: ((u["line_no"] == 0) | u["line_no"].between(F.col("from"), F.col("to"))) & (u["shared"] >= F.col("shared")))
    rows = rows.where(~F.coalesce(said, F.lit(False)))
    one = F.struct((-F.col("shared")).alias("a"), (-F.col("dice")).alias("d"), "licence", "s", "e", "from", "shared", "line_bigrams", "template_bigrams", "dice")
    ranked = rows.groupBy("doc_id", "_m").agg(F.array_sort(F.collect_list(one)).alias("_l"))
    none = F.filter("_l", lambda _: F.lit(False))
    apart = lambda acc, x: F.when(F.exists(acc, lambda y: (y["s"] <= x["e"] + 1) & (x["s"] <= y["e"] + 1)), acc).otherwise(F.concat(acc, F.array(x)))
    kept = ranked.select("doc_id", "_m", F.explode(F.aggregate("_l", none, apart)).alias("k"))
    return kept.select("doc_id", "_m", F.col("k.from").alias("line_no"), F.struct("k.d", "k.licence", "k.shared", "k.line_bigrams", "k.template_bigrams", "k.dice").alias("_r"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in TEMPLATES.items())
    cut = """SELECT {key}, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x
             FROM (SELECT {key}, list_filter(string_split_regex(lower(l), '[^\\p{{L}}\\p{{N}}]+'), lambda a: a <> '') AS w FROM {rows})"""
    return f"""
        WITH t(licence, l) AS (VALUES {rows}),
             u AS (SELECT DISTINCT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_concat([text], string_split(text, chr(10))) ELSE [text] END) AS l,
                          unnest(range(0, CASE WHEN contains(text, chr(10)) THEN 1 + len(string_split(text, chr(10))) ELSE 1 END)) AS line_no
                   FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
             tb AS ({cut.format(key="licence", rows="t")}), ub AS ({cut.format(key="doc_id, line_no", rows="u")}),
             tn AS (SELECT licence, count(*) AS template_bigrams FROM tb GROUP BY 1),
             un AS (SELECT doc_id, line_no, count(*) AS line_bigrams FROM ub GROUP BY 1, 2),
             j AS (SELECT doc_id, line_no, licence, count(*) AS shared FROM ub JOIN tb USING (x) GROUP BY 1, 2, 3)
        SELECT doc_id, line_no, licence, shared, line_bigrams, template_bigrams, 2.0::DOUBLE * shared / (line_bigrams + template_bigrams) AS dice
        FROM j JOIN tn USING (licence) JOIN un USING (doc_id, line_no) WHERE 2.0::DOUBLE * shared / (line_bigrams + template_bigrams) >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY 2.0::DOUBLE * shared / (line_bigrams + template_bigrams) DESC, licence) = 1"""


SQL = {"op3_license_scan": _sql()}

"""Operator 5: licence scan by Dice coefficient over word bigrams, in DataFrame functions only.

Lines, paragraphs of several lines and, if short enough, whole texts are normalised (A-Z lower-cased, everything
but ASCII letters and digits is one space) and compared with licence templates, notices and whole licence texts
and their paragraphs, as sets of word bigrams. A Dice coefficient of t needs set sizes within t / (2 - t) of each
other. Sizes fall into bands; a template is listed under the bands of the sizes that it admits, candidates come
from an equi-join on the band, and exact size bounds prune them before any sets are compared.

Defined cases: null, empty and one-word units match nothing; a paragraph of one line is judged as a line only, and
a text of one paragraph as lines and a text; ties list every template; repeated rows are judged each for itself;
units of any length are judged, long ones by their number of distinct words first; an empty table gives an empty
result; other columns are ignored, so their names cannot clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table

# Notices and licence texts as licensors word them; a blank line separates paragraphs.
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.\n\n"
    "You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n'
        "http://www.apache.org/licenses/LICENSE-2.0\n\n"
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n'
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _WARRANTY,
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        _GNU.format(what="program", name="General Public License", version="3"),
    ),
    "GPL-2.0": (_GNU.format(what="program", name="General Public License", version="2").replace("software: you", "software; you"),),
    "LGPL-3.0": (_GNU.format(what="library", name="Lesser General Public License", version="3"),),
    "AGPL-3.0": (_GNU.format(what="program", name="Affero General Public License", version="3"),),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "BSD-2-Clause": (f"{_BSD_TERMS}\n\n{_BSD_WARRANTY}",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", f"{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_WARRANTY}"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "proprietary": ("All rights reserved.",),
}
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigram_set(text: str) -> set[str]:
    words = normal_words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


#: Template rows up to which every task holds the whole table.
HELD_ROWS = 20_000
#: Sizes from BAND^k to BAND^(k + 1) are one band.
BAND = 1.5


def parts_of(texts: tuple[str, ...]) -> list[str]:
    """Each text, and each of its paragraphs once, if of two words or more."""
    found = dict.fromkeys(x for t in texts for x in (t, *t.split("\n\n")))
    return [x for x in found if len(normal_words(x)) > 1]


def band_of(size: int) -> int:
    return math.floor(math.log(size) / math.log(BAND) + 1e-9)


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """The set sizes that can reach the threshold with a template of this size."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - 1e-9)), math.floor(size * (2 - threshold) / threshold + 1e-9)


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]], threshold: float) -> DataFrame:
    """A row for each template and each of the few bands it admits; grows with the templates only. Up to
    ``HELD_ROWS`` it is sent to all tasks, so no unit is shuffled by its size."""
    rows = []
    for name, texts in templates.items():
        for k, text in enumerate(parts_of(texts)):
            grams = sorted(bigram_set(text))
            low, high = bounds(len(grams), threshold)
            rows += [(name, k, grams, len(grams), low, high, band) for band in range(band_of(low), band_of(high) + 1)]
    found = spark.createDataFrame(rows, "license string, variant int, template array<string>, template_size int, low int, high int, band int")
    return F.broadcast(found) if sum(len(r[2]) for r in rows) <= 100 * HELD_ROWS and len(rows) <= HELD_ROWS else found


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def _words(unit: Column) -> Column:
    return F.split(_normal(unit), " ")


BLANK = r"\n[ \t\r\n]*\n"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (line, paragraph or text), line (number of the line or paragraph from 0; -1: the text), license,
    variant, size, dice of each match."""
    known = template_table(docs.sparkSession, templates, threshold)
    most = max([1, *(bounds(len(bigram_set(t)), threshold)[1] for texts in templates.values() for t in parts_of(texts))])
    lines, paragraphs = F.split("text", "\n"), F.split("text", BLANK)
    several = F.filter(F.transform(paragraphs, lambda x, i: F.struct(x.alias("x"), i.alias("line"))), lambda p: F.trim(p["x"]).contains("\n"))
    unit = lambda kind, x, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("line"), _words(x).alias("words"))
    whole = F.when(F.size(lines) > 1, F.array(unit("text", F.col("text"), F.lit(-1))))
    blocks = F.when(F.size(paragraphs) > 1, F.transform(several, lambda p: unit("paragraph", p["x"], p["line"])))
    nothing = F.array().cast("array<struct<unit:string,line:int,words:array<string>>>")
    # words are made inside the generator, so that no filter below makes them a second time
    all_units = F.concat(F.transform(lines, lambda x, i: unit("line", x, i)), F.coalesce(blocks, nothing), F.coalesce(whole, nothing))
    units = docs.filter("text IS NOT NULL").select("doc_id", F.inline(all_units))
    # n distinct words make n - 1 distinct bigrams or more, so long units go before their bigrams are built
    words = units.filter((F.size("words") > 1) & (F.size(F.array_distinct("words")) - 1 <= most))
    grams = F.array_distinct(F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    sized = words.select("doc_id", "unit", "line", grams.alias("grams")).withColumn("size", F.size("grams")).filter(F.col("size") <= most)
    # what reaches t shares t / (2 - t) of its bigrams with one template, so with all of them: most units go here
    every = sorted({g for texts in templates.values() for t in parts_of(texts) for g in bigram_set(t)})
    shared = F.size(F.filter("grams", lambda g: g.isin(every)))
    sized = sized.filter(shared >= F.col("size") * (threshold / (2 - threshold)) - 1e-6)
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(BAND) + 1e-9).cast("int")
    both = sized.withColumn("band", band).join(known, "band").filter(F.col("size").between(F.col("low"), F.col("high")))
    scored = both.withColumn("dice", 2 * F.size(F.array_intersect("grams", "template")) / (F.col("size") + F.col("template_size")))
    return scored.filter(F.col("dice") >= threshold).select("doc_id", "unit", "line", "license", "variant", F.col("size").cast("long").alias("size"), F.round("dice", 6).alias("dice"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    rows = ", ".join(f"('{name}', {k}, '{t.replace(chr(39), chr(39) * 2)}')" for name, texts in TEMPLATES.items() for k, t in enumerate(parts_of(texts)))
    words = "string_split(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), ' ')"
    blank = r"'\n[ \t\r\n]*\n'"
    return f"""
WITH t AS (SELECT license, variant::INTEGER AS variant, {words.format("text")} AS w FROM (VALUES {rows}) AS v(license, variant, text)
), tg AS (SELECT license, variant, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL
), blocks AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, {blank})) AS x, generate_subscripts(regexp_split_to_array(text, {blank}), 1) - 1 AS line FROM documents WHERE regexp_matches(text, {blank})
), units AS (
  SELECT doc_id, 'line' AS unit, line, x FROM lines
  UNION ALL SELECT doc_id, 'paragraph', line, x FROM blocks WHERE contains(trim(x, ' '), chr(10))
  UNION ALL SELECT doc_id, 'text', -1, text FROM documents WHERE contains(text, chr(10))
), uw AS (SELECT doc_id, unit, line, {words.format("x")} AS w FROM units
), ug AS (SELECT doc_id, unit, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM uw WHERE len(w) > 1
), scored AS (
  SELECT doc_id, unit, line::INTEGER AS line, license, variant, len(ug.g)::BIGINT AS size, 2 * len(list_intersect(ug.g, tg.g)) / (len(ug.g) + len(tg.g)) AS dice
  FROM ug JOIN tg ON len(ug.g) BETWEEN 1 AND 2 * len(tg.g)
)
SELECT doc_id, unit, line, license, variant, size, round(dice, 6) AS dice FROM scored WHERE dice >= {THRESHOLD}
"""


OP5_SQL = _op5_sql()

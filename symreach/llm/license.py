"""Licence scans by Dice coefficient over word bigrams (DataFrame functions only).

A text's units are its lines, its paragraphs (between blank lines) of several lines, and the whole text if it has several paragraphs. A unit's words
are lower-cased runs of letters and digits; its bigrams form a set. Dice is 2 |A n B| / (|A| + |B|), so it can
reach t only if |A| lies between t |B| / (2 - t) and (2 - t) |B| / t: each unit meets only the templates that its size allows, through a join on the size. Within the bounds, |A n B|
is at least |B| t / (2 - t), so a unit without any of the words that stand in more than the rest of a template's bigrams
can't reach it: units without such a word of any template are dropped before their bigrams are built.

Null or empty text: no match. Repeated rows: each is scanned. Null doc_id: kept. Ties of templates: the name that sorts first.
Other columns are ignored."""

from __future__ import annotations

import re
from fractions import Fraction
from math import floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = "0.8"

# Public licence texts and notices.
TEMPLATES = {
    "AGPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 short": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD short": "Released under the BSD License.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 short": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 short": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0 short": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT short": "Released under the MIT License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def with_bigrams(df: DataFrame, text: str, out: str, hits: list[str] | None = None) -> DataFrame:
    """df with the set of the text column's word bigrams; a single word is one by itself. Only rows with a word of hits, if given."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    n = F.size("_words")
    # Zipped, not indexed: an index would have the words split again for each bigram wherever the optimizer merges the two columns.
    two = F.zip_with(F.slice("_words", F.lit(1), n - 1), F.slice("_words", F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    d = df.withColumn("_words", words)
    if hits is not None:
        d = d.where(F.arrays_overlap("_words", F.array(*map(F.lit, hits))))
    return d.withColumn(out, F.when(n > 1, F.array_distinct(two)).otherwise(F.col("_words"))).drop("_words")


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES, least: str = LEAST) -> DataFrame:
    """size, license, own: each template (its bigrams in own) once for each size of a unit that its bounds allow."""
    t = Fraction(least)
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(texts.items())])
    d = spark.range(1).select(F.explode(rows).alias("x")).select("x.license", "x.text")
    d = with_bigrams(d, "text", "own").drop("text")
    low, high = t / (2 - t), (2 - t) / t
    n = F.size("own")
    # Whole numbers, so that the bounds are exact.
    lowest = F.ceil(n * low.numerator / F.lit(low.denominator) - 1e-9)
    highest = F.floor(n * high.numerator / F.lit(high.denominator) + 1e-9)
    return d.withColumn("size", F.explode(F.sequence(F.greatest(lowest, F.lit(1)).cast("int"), highest.cast("int"))))


def _grams(text: str) -> list[tuple[str, ...]]:
    w = re.findall(r"[^\W_]+", text.lower())
    return sorted(set(zip(w, w[1:]))) if len(w) > 1 else [tuple(w)]


def fewest_bigrams(texts: dict[str, str] = TEMPLATES, least: str = LEAST) -> int:
    """A lower bound of the distinct bigrams of a unit that reaches `least` with some template."""
    t = Fraction(least)
    return max(1, floor(min(len(_grams(x)) for x in texts.values()) * t / (2 - t)))


def hit_words(texts: dict[str, str] = TEMPLATES, least: str = LEAST) -> list[str]:
    """Words of which any unit that reaches `least` with some template holds one.

    With the size bounds, such a unit shares at least t / (2 - t) of the template's bigrams. So words that stand in more than
    the rest of its bigrams can't all be missing. Long words are taken first: they are rare elsewhere."""
    share = Fraction(least) / (2 - Fraction(least))
    out: set[str] = set()
    for text in texts.values():
        grams = _grams(text)
        for word in sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w)):
            if sum(any(w in out for w in g) for g in grams) > (1 - share) * len(grams):
                break
            out.add(word)
    return sorted(out)


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES, least: str = LEAST) -> DataFrame:
    """doc_id, scope (line, paragraph, text), unit (from 0), license and dice of each unit of docs (doc_id, text) that reaches `least`."""
    spark = docs.sparkSession
    fewest = fewest_bigrams(texts, least)
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_t")).where("_t IS NOT NULL")
    paragraphs = F.split("_t", r"\n[ \t\r]*(?:\n[ \t\r]*)+", -1)
    lines = F.split("_t", "\n", -1)
    several = F.transform(paragraphs, lambda x, i: F.struct(F.lit("paragraph").alias("scope"), i.alias("unit"), x.alias("u")))
    one = F.transform(lines, lambda x, i: F.struct(F.lit("line").alias("scope"), i.alias("unit"), x.alias("u")))
    whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(0).alias("unit"), F.col("_t").alias("u")))
    long = F.filter(several, lambda x: F.instr(x["u"], "\n") > 0)
    units = F.concat(one, long, F.when(F.size(paragraphs) > 1, whole).otherwise(F.slice(whole, 1, 0)))
    d = d.select("doc_id", F.explode(units).alias("x")).select("doc_id", "x.scope", "x.unit", "x.u")
    # A cheap bound first: n bigrams take n words of one character and a gap each. The join on the size holds the exact bounds.
    d = d.where(F.length("u") >= 2 * fewest)
    d = with_bigrams(d, "u", "set", hit_words(texts, least)).drop("u").withColumn("size", F.size("set"))
    found = d.join(F.broadcast(templates(spark, texts, least)), "size")
    dice = 2 * F.size(F.array_intersect("set", "own")) / (F.size("set") + F.size("own"))
    found = found.withColumn("dice", dice).where(F.col("dice") >= float(least))
    # Several templates may fit a unit: the best stays. Rows that are alike are units of their own.
    ranked = found.groupBy("doc_id", "scope", "unit", "set").agg(F.min(F.struct((-F.col("dice")).alias("down"), "license")).alias("best"), F.count("*").alias("_n"), F.count_distinct("license").alias("_k"))
    ranked = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_n") / F.col("_k")).cast("int"))))
    return ranked.select("doc_id", "scope", "unit", F.col("best.license").alias("license"), (-F.col("best.down")).alias("dice"))

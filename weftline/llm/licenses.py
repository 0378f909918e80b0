"""License scan: text segments compared with licence templates by Dice coefficient, in DataFrame operations only.

A segment is a line, a paragraph (between blank lines), the whole text, or a window of the text's words
that holds a licence which is none of these by itself: wrapped in a comment, within a line, or joined to
other text. Segments and templates are normalised to lower-case words and compared as sets of word bigrams.

* Texts without any of a few telling words can have no hit and go no further.
* A template can only reach the threshold t on a segment whose number of bigrams lies between t/(2-t) and
  (2-t)/t times its own. Segments' bigrams meet the templates' in a join with that bound; counts give the coefficients.
* Windows: the whole text's bigrams that a template shares are points of a walk that gains 2-t at each and loses t
  at every other bigram, so a stretch gains t times the template's length exactly if its coefficient reaches t.
  One pass over the points finds the best stretches of any template, however long. It breaks off where a stretch
  has lost more than a window may, or is longer than a window may be.

What is joined against is a fixed list of templates, so it is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, drop_scratch, materialize, scratch_tables

THRESHOLD = 0.8
_NOT_WORD = r"[^\p{L}\p{N}]+"

#: How much of what a window must gain it may lack before repeated words are set aside, and how much longer it may be.
_SLACK, _LONGER = 0.85, 1.1

# Licence texts and notices, as published by their authors.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
    "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
    "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
    "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
    "relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
    "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any "
    "source distribution."
)
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSD-3-Clause", _BSD_THIRD.removeprefix("3. ")),
    (
        "GPL-3.0",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ),
    (
        "GPL-2.0",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute "
        "verbatim copies of this license document, but changing it is not allowed.",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", _MIT),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    # whole licences, as published
    *((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
)


def _words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _words_of(text)
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def _templates(templates) -> list[tuple[int, str, list[str]]]:
    return [(k, name, _bigrams(text)) for k, (name, text) in enumerate(templates)]


_COMMON = frozenset("a all an and any are as at be but by conditions following for from general in including is it no not of on or original other out provided shall that the this to under use with without you".split())


def telling_words(temps: list[tuple[int, str, list[str]]], threshold: float) -> list[str]:
    """Words of which every text with a hit holds one.

    A hit shares at least t/(2-t) of its template's bigrams, so it is enough that for each template the bigrams
    without any of the words are fewer. Words that cover many bigrams come first, common ones last.
    """
    chosen: set[str] = set()
    for _, _, bigrams in sorted(temps, key=lambda t: len(t[2])):
        left = [b for b in bigrams if not chosen & set(b.split(" "))]
        while 2 * len(left) >= threshold * (len(left) + len(bigrams)) - 1e-9:
            covered = Counter(w for b in left for w in set(b.split(" ")))
            chosen.add(best := min(covered, key=lambda w: (w in _COMMON, len(w) < 6, -covered[w], -len(w), w)))
            left = [b for b in left if best not in b.split(" ")]
    return sorted(chosen)


def _words(segment: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(segment), _NOT_WORD, " "), " "), lambda w: w != "")


def _pairs(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))


def _lookup(spark, templates) -> DataFrame:
    """(bigram, b, k, license, s, p): a row for each bigram of each template k, b its hash; s its distinct bigrams, p all with repeats."""
    named = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "k int, license string, text string")
    pairs = named.select("k", "license", _pairs(_words(F.col("text"))).alias("g"))
    # sizes are taken before the arrays are exploded; beside an explode they would be taken anew for every row of it
    sized = pairs.select("k", "license", F.size("g").alias("p"), F.array_distinct("g").alias("g")).withColumn("s", F.size("g"))
    rows = sized.select("k", "license", "s", "p", F.explode("g").alias("bigram"))
    return F.broadcast(rows.withColumn("b", F.xxhash64("bigram")))


def _scored(segs: DataFrame, lookup: DataFrame, threshold: float) -> DataFrame:
    """(r, hit) for segs(r, pos, segment): the templates that reach the threshold on a segment and do as well as any other."""
    lo, hi = threshold / (2 - threshold), (2 - threshold) / threshold
    g = segs.select("r", "pos", F.array_distinct(_pairs(F.split("segment", " "))).alias("g")).withColumn("n", F.size("g"))
    each = g.select("r", "pos", "n", F.explode("g").alias("bigram")).join(lookup, "bigram")
    each = each.where((F.col("n") >= F.col("s") * lo) & (F.col("n") <= F.col("s") * hi))
    counted = each.groupBy("r", "pos", "n", "k", "license", "s").agg(F.count("*").cast("int").alias("common"))
    hits = counted.withColumn("dice", 2.0 * F.col("common") / (F.col("n") + F.col("s"))).where(F.col("dice") >= threshold)
    hits = hits.withColumn("top", F.max("dice").over(Window.partitionBy("r", "pos"))).where("dice = top")  # as many rows as templates at most
    named = hits.join(segs, ["r", "pos"])
    return named.select("r", F.struct("segment", F.col("k").alias("template"), "license", "dice", "common").alias("hit"))


def _stretches(at: Column, p: Column, threshold: float) -> Column:
    """array<struct<a, z>>: first and last position of the stretches of the sorted positions ``at`` that gain enough; see the module's docstring."""
    gain, loss = 2.0 - threshold, threshold
    drop = loss * ((2 - threshold) ** 2 / (2 * threshold) - threshold / 2) * p
    long = (2 - threshold) / threshold * _LONGER * p
    begin = lambda i: {"sum": F.lit(gain), "from": i, "last": i, "best": F.lit(gain), "to": i}
    state = lambda d, out: F.struct(*[v.alias(n) for n, v in d.items()], out.alias("out"))
    closed = lambda s: F.when(s["best"] >= threshold * _SLACK * p, F.concat(s["out"], F.array(F.struct(s["from"].alias("a"), s["to"].alias("z"))))).otherwise(s["out"])

    def step(s: Column, i: Column) -> Column:
        left = s["sum"] - loss * (i - s["last"] - 1)
        ends = (left <= 0) | (s["best"] - left > drop) | (i - s["from"] + 1 > long)
        now = left + gain
        better = now > s["best"]
        on = {"sum": now, "from": s["from"], "last": i, "best": F.when(better, now).otherwise(s["best"]), "to": F.when(better, i).otherwise(s["to"])}
        return F.when(ends, state(begin(i), closed(s))).otherwise(state(on, s["out"]))

    nothing = F.array().cast("array<struct<a: int, z: int>>")
    first = state(begin(F.get(at, F.lit(0))), nothing)
    return F.aggregate(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), first, step, closed)


def _windows(texts: DataFrame, lookup: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """(r, pos, segment): the texts' windows that reach the threshold, those of the most bigrams first where windows share words, without windows inside a segment that has a hit."""
    lo = threshold / (2 - threshold)
    w = texts.select("r", _words(F.col("text")).alias("w")).select("r", "w", _pairs(F.col("w")).alias("g"))
    points = w.select("r", F.posexplode("g").alias("i", "bigram")).join(lookup, "bigram").groupBy("r", "k", "s", "p").agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("at"))
    distinct = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["b"])))
    points = points.where(distinct(F.col("at")) >= F.col("s") * lo)
    found = points.select("r", "s", "at", F.inline(_stretches(F.transform("at", lambda x: x["i"]), F.col("p"), threshold)))
    found = found.select("r", "s", "a", "z", distinct(F.filter("at", lambda x: (x["i"] >= F.col("a")) & (x["i"] <= F.col("z")))).alias("n"))
    found = found.join(w, "r").withColumn("of", F.size(F.array_distinct(F.slice("g", F.col("a") + 1, F.col("z") - F.col("a") + 1))))
    found = found.withColumn("dice", 2.0 * F.col("n") / (F.col("of") + F.col("s"))).where(F.col("dice") >= threshold)
    segment = F.array_join(F.slice("w", F.col("a") + 1, F.col("z") - F.col("a") + 2), " ")
    spans = found.select("r", F.struct((-F.col("n")).alias("n"), (-F.col("dice")).alias("d"), "a", "z", segment.alias("segment")).alias("x"))
    spans = spans.groupBy("r").agg(F.array_sort(F.collect_set("x")).alias("x"))  # few a text
    free = F.aggregate("x", F.slice("x", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: (x["a"] <= k["z"] + 1) & (k["a"] <= x["z"] + 1)), kept).otherwise(F.concat(kept, F.array(x))))
    known = hits.groupBy("r").agg(F.collect_set("hit.segment").alias("known"))
    rows = spans.select("r", free.alias("x")).join(known, "r", "left")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    fresh = F.filter(F.transform("x", lambda x: x["segment"]), lambda x: ~F.coalesce(F.exists("known", lambda k: F.contains(padded(k), padded(x))), F.lit(False)))
    return rows.select("r", F.posexplode(F.array_distinct(fresh)).alias("pos", "segment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``hits`` array<struct<segment, template, license, dice, common>>.

    A hit is a distinct normalised segment (its words joined by blanks) whose Dice coefficient with a
    template is at least ``threshold`` and as high as with any other; template is the template's position, common
    the number of bigrams shared.
    Texts without any of the telling_words() can have no hit and are not looked at. Segments of less than two
    words have no bigrams and never hit. Windows that share words give way to the one with the most
    bigrams of a template, and windows inside a segment with a hit are left out. Null and empty texts have no hits; very long texts are scanned
    whole; repeated rows and null ids have each their own row; ties of hits are settled in digest(). Other
    columns don't matter, whatever their names. An empty table gives an empty table.
    """
    temps = _templates(templates)
    lo = threshold / (2 - threshold)
    least = min(len(b) for *_, b in temps) * lo
    lookup = _lookup(docs.sparkSession, templates)
    since = scratch_tables()
    telling = F.arrays_overlap(F.split(F.lower(F.col(text_col)), _NOT_WORD), F.array(*map(F.lit, telling_words(temps, threshold))))
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("doc_id"), F.when(telling, F.col(text_col)).alias("text"))
    rows = materialize(rows, "texts", TEXT_ROWS)
    texts = rows.where("text IS NOT NULL").select("r", "text")
    blank = r"\r?\n[ \t]*\r?\n"
    none = F.array().cast("array<string>")
    more = F.when(F.rlike("text", F.lit(r"\n")), F.concat(F.when(F.rlike("text", F.lit(blank)), F.split("text", blank)).otherwise(none), F.array("text"))).otherwise(none)
    normal = F.array_distinct(F.transform(F.concat(F.split("text", r"\r?\n"), more), lambda x: F.array_join(_words(x), " ")))
    segs = texts.select("r", F.posexplode(normal).alias("pos", "segment"))
    # size bounds before any bigram is made: distinct bigrams are at most words - 1
    words = F.char_length("segment") - F.char_length(F.replace("segment", F.lit(" "), F.lit(""))) + 1
    segs = materialize(segs.where((words - 1 >= least) & (words > 1)), "segments")
    hits = materialize(_scored(segs, lookup, threshold), "hits")
    windows = materialize(_windows(texts, lookup, hits, threshold), "windows")
    every = hits.unionByName(_scored(windows, lookup, threshold)).groupBy("r").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    empty = F.array().cast("array<struct<segment: string, template: int, license: string, dice: double, common: int>>")
    out = materialize(rows.select("r", "doc_id").join(every, "r", "left").select("doc_id", F.coalesce("hits", empty).alias("hits")), "scanned")
    drop_scratch(since, out)
    return out


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_segments (distinct segments with a hit), licenses (sorted, comma-joined), best_license, best_dice (six places).

    The best hit shares the most bigrams, then has the highest coefficient, then the first template: a whole text
    tells more than a sentence of it. No hit: 0, '', null, null.
    """
    rank = F.transform("hits", lambda h: F.struct(h["common"].alias("c"), F.round(h["dice"], 6).alias("d"), (-h["template"]).alias("t"), h["license"].alias("l")))
    return scanned.select("doc_id", "hits", F.array_max(rank).alias("best")).select(
        "doc_id",
        F.size(F.array_distinct(F.transform("hits", lambda h: h["segment"]))).cast("long").alias("n_segments"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",").alias("licenses"),
        F.col("best.l").alias("best_license"),
        F.col("best.d").alias("best_dice"),
    )


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({k}, {quote(n)}, [{', '.join(map(quote, b))}])" for k, n, b in _templates(templates))
    return f"""
WITH t(k, license, b) AS (VALUES {rows}),
p AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
),
s AS (
  SELECT r, unnest(string_split_regex(text, '\\r?\\n')) AS seg FROM p
  UNION ALL SELECT r, unnest(string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n')) FROM p
  UNION ALL SELECT r, text FROM p
),
w AS (
  SELECT DISTINCT r, trim(regexp_replace(lower(seg), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS segment FROM s
),
g AS (
  SELECT r, segment, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS g
  FROM (SELECT r, segment, string_split(segment, ' ') AS x FROM w) WHERE len(x) > 1
),
h AS (
  SELECT r, segment, k, license, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice, len(list_intersect(g, b)) AS common
  FROM g JOIN t ON len(g) BETWEEN len(b) * {threshold / (2 - threshold)} AND len(b) * {(2 - threshold) / threshold}
  WHERE 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) >= {threshold}
  QUALIFY dice = max(dice) OVER (PARTITION BY r, segment)
),
a AS (
  SELECT r, count(DISTINCT segment) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         first(license ORDER BY common DESC, round(dice, 6) DESC, k) AS best_license, first(round(dice, 6) ORDER BY common DESC, round(dice, 6) DESC, k) AS best_dice
  FROM h GROUP BY r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_segments, coalesce(licenses, '') AS licenses, best_license, best_dice::DOUBLE AS best_dice
FROM p LEFT JOIN a USING (r)
"""

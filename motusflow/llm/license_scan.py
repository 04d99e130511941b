"""License notices in texts, by built-in functions only.

A text's words (runs of letters and digits, lower case) give shingles of five. Overlapping windows of WINDOW words get BANDS
MinHash values of one row each, and so do the templates' windows. A template of which any value occurs in a text is a candidate;
it counts if the exact share of the template's shingles that the text holds reaches the threshold.

Two windows that share one of their three shingles miss all bands with probability (1 - 1/3) ** 16 = 0.0015, and equal ones
never. A template that a text holds whole has, cut at any place, a window with two of its shingles for every two words, unless it is
one shingle only, which a window holds among two at most: (1 - 1/2) ** 16 < 2e-5.

Templates are few and public, so their bands stand in the plan as one set of literals, which every band value of a text is looked
up in: work in proportion to the text, however many templates there are. Only a text with a hit is compared with them. Every text is
judged in its own row, and nothing is shuffled.

Defined cases: a null or empty text, or one of fewer than five words, has no match; repeated rows are judged one by one;
several licenses in a text are all returned, by name; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a shingle and of a window, words from one window to the next, and MinHash values of a window.
WORDS, WINDOW, STEP, BANDS = 5, 6, 2, 16
THRESHOLD = 0.8
#: Notices by license (fixed values: public texts).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles_of(words: Column) -> Column:
    """64-bit hashes of the shingles, repeats included."""
    last = F.size(words) - WORDS + 1
    places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WORDS))))


def bands_of(shingles: Column, known: list[int] | None = None) -> Column:
    """The band values of all windows of the shingles, distinct; with ``known``, those among them."""
    n = F.size(shingles)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(STEP))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(*(F.element_at(shingles, F.least(i + k, n)).alias(f"s{k}") for k in range(WINDOW - WORDS + 1))))

    def of_window(w: Column) -> Column:
        values = F.array(*(F.xxhash64(F.lit(b), F.least(*(F.xxhash64(w[f"s{k}"], F.lit(b)) for k in range(WINDOW - WORDS + 1)))) for b in range(BANDS)))
        return values if known is None else F.filter(values, lambda v: v.isin(known))

    return F.array_distinct(F.flatten(F.transform(windows, of_window)))


def template_rows(df: DataFrame, templates: dict[str, str]) -> list:
    """name, shingles, bands of every template, by name. Their number is a parameter, not the corpus's."""
    rows = df.sparkSession.createDataFrame(sorted(templates.items()), "name string, text string").coalesce(1)
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("all", shingles_of(F.col("words")))
    rows = rows.filter(F.size("all") > 0).select("name", F.array_distinct("all").alias("shingles"), bands_of(F.col("all")).alias("bands"))
    return sorted(rows.collect())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, matches (array of license name and containment, by name) for every row."""
    found = template_rows(docs, TEMPLATES if templates is None else templates)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)).cast("array<bigint>")
    known = F.array(*(F.struct(F.lit(r["name"]).alias("name"), longs(r["shingles"]).alias("shingles"), longs(r["bands"]).alias("bands")) for r in found))
    none = F.array().cast("array<struct<name:string,containment:double>>")
    # each step names its array as a column: inside a function of elements an expression would be computed for every element
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    rows = rows.select("doc_id", shingles_of(F.col("words")).alias("found"))
    if not found:
        return rows.select("doc_id", none.alias("matches"))
    rows = rows.select("doc_id", "found", bands_of(F.col("found"), sorted({b for r in found for b in r["bands"]})).alias("hits"))
    candidates = F.filter(known, lambda t: F.arrays_overlap(t["bands"], F.col("hits")))
    judged = F.transform(candidates, lambda t: F.struct(t["name"].alias("name"), (F.size(F.array_intersect(t["shingles"], F.col("found"))) / F.size(t["shingles"])).alias("containment")))
    matches = F.when(F.size("hits") > 0, F.filter(judged, lambda m: m["containment"] >= threshold)).otherwise(none)
    return rows.select("doc_id", matches.alias("matches"))


def digest(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (names joined by commas), best (highest containment, 0 without a match)."""
    m = F.col("matches")
    return scan(docs, templates, threshold).select(
        "doc_id",
        F.size(m).cast("long").alias("n_licenses"),
        F.array_join(F.transform(m, lambda x: x["name"]), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform(m, lambda x: x["containment"])), F.lit(0.0)), 6).alias("best"),
    )


def digest_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the same rows, by exact containment of every template in every text."""
    rows = []
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        words = re.findall(r"[^\W_]+", text.lower())
        found = sorted({" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)})
        rows += [f"('{name}', '{s}', {len(found)})" for s in found]
    return f"""
WITH t(name, shingle, total) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(ws) - {WORDS - 1}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')))) AS shingle FROM w),
m AS (SELECT doc_id, name, count(*) / max(total)::DOUBLE AS c FROM s JOIN t USING (shingle) GROUP BY ALL),
g AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS licenses, round(max(c), 6) AS best FROM m WHERE c >= {threshold} GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(best, 0.0) AS best FROM documents d LEFT JOIN g USING (doc_id)
"""

"""License scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

Text is normalised (lower case; everything but letters and digits is one space).  Passages of a
document are its lines, its paragraphs of several lines, and the whole text if it has several
paragraphs.  A passage of a bigrams and a template of b share a multiset of m bigrams, and their
coefficient is 2 m / (a + b).  As m is at most the lesser, a template can reach the threshold t only
with sizes between t / (2 - t) and (2 - t) / t of the passage's, so templates are joined by size and
most passages are gone before any bigram is made; then one shared bigram is asked for, and only then
are the multisets compared.  Of the templates at the threshold a passage is named by the nearest, so
that a notice isn't taken for its relatives (versions of one licence differ in a word).

Templates are the fixed list below, or a folder of texts (``read_templates``: a file for each, named
after its licence); their paragraphs of ten words and more count as templates too.  They are
broadcast: a row for each allowed size of each, within ``MOST_BYTES``, whatever the documents are; a
list that is larger is joined by size without.

Defined results: a null text has no passages; a passage of one word has no bigrams and matches
nothing; repeated rows each get the same result; of several equally near templates all are named.
Columns other than the id and the text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import keyed

#: Threshold in tenths, so that sizes and coefficients are compared in integers.
TENTHS = 8
#: Bytes of templates, each times its allowed sizes, that are broadcast.
MOST_BYTES = 64 << 20

#: Public notices and licence texts, by SPDX-like name.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Proprietary", "All rights reserved."),
]

_OTHER = r"[^\p{L}\p{N}\n]+"


def template_passages(templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """Names and bigrams of the templates and of their longer paragraphs, each once."""
    out: dict[tuple[str, str], list[str]] = {}
    for name, text in templates:
        paragraphs = text.split("\n\n")
        for part in [text, *(p for p in paragraphs if len(paragraphs) > 1 and len(p.split()) >= 10)]:
            w = re.sub(r"[\W_]+", " ", part.lower()).split()
            if len(w) > 1:
                out[name, " ".join(w)] = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    return [(name, bigrams) for (name, _), bigrams in out.items()]


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Templates from a folder of text files, named after their files without an ending; read by Spark, wherever it is."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt)?$", 1).alias("name"), "value")
    return sorted((r.name, r.value) for r in rows.collect())


def _with_passages(rows: DataFrame) -> DataFrame:
    """With ``_passages``, normalised: lines, paragraphs of several lines, and the whole if it has several paragraphs.

    Each step is a column of its own, so that it is computed once.
    """
    flat = lambda x: F.trim(F.regexp_replace(x, "[ \n]+", " "))
    rows = rows.withColumn("_norm", F.regexp_replace(F.lower("_text"), _OTHER, " "))
    rows = rows.withColumn("_pars", F.split("_norm", "\n ?\n[ \n]*"))
    several = F.transform(F.filter("_pars", lambda p: F.contains(p, F.lit("\n"))), flat)
    whole = F.when(F.size("_pars") > 1, F.array(flat(F.col("_norm")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_passages", F.concat(F.transform(F.split("_norm", "\n"), lambda x: F.trim(x)), several, whole))


def _times(bigrams: Column, one: Column) -> Column:
    return F.size(F.filter(bigrams, lambda x: x == one))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tenths: int = TENTHS, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Per row: the id, n_passages (that match a template), licenses (sorted names), best (the greatest coefficient, or null)."""
    spark = docs.sparkSession
    rows, made = keyed(docs, id_col, text_col), template_passages(templates)
    known = spark.createDataFrame([(name, b, len(b)) for name, b in made], "_name string, _template array<string>, _b int")
    # sizes a with 2 min(a, b) / (a + b) >= t
    lo, hi = F.ceil(F.col("_b") * tenths / (20 - tenths)).cast("int"), F.floor(F.col("_b") * (20 - tenths) / tenths).cast("int")
    known = known.select("_name", "_template", "_b", F.explode(F.sequence(lo, hi)).alias("_a"))
    sizes = [len(b) for _, b in made]
    # a template of b bigrams has some 0.85 b allowed sizes
    known = F.broadcast(known) if sum(len(b) * sum(map(len, b)) for _, b in made) <= MOST_BYTES else known
    least, most = -(-min(sizes) * tenths // (20 - tenths)), max(sizes) * (20 - tenths) // tenths
    each = F.transform("_passages", lambda p: F.struct(p.alias("_p"), (F.char_length(p) - F.char_length(F.replace(p, F.lit(" "), F.lit("")))).alias("_a")))
    sized = _with_passages(rows).select("_id", "_th", F.posexplode(each).alias("_at", "_x")).select("_id", "_th", "_at", F.col("_x._p").alias("_p"), F.col("_x._a").alias("_a"))
    passages = sized.where(F.col("_a").between(least, most)).withColumn("_words", F.split("_p", " ")).drop("_p")
    bigrams = F.zip_with(F.slice("_words", 1, F.col("_a")), F.slice("_words", 2, F.col("_a")), lambda x, y: F.concat(x, F.lit(" "), y))
    pairs = passages.withColumn("_own", bigrams).drop("_words").join(known, "_a").where(F.arrays_overlap("_own", "_template"))
    shared = F.aggregate(F.array_distinct(F.array_intersect("_own", "_template")), F.lit(0), lambda n, x: n + F.least(_times(F.col("_own"), x), _times(F.col("_template"), x)))
    pairs = pairs.withColumn("_m", shared).where(20 * F.col("_m") >= tenths * (F.col("_a") + F.col("_b")))
    # of each passage the nearest: quotients of equal value are equal doubles
    near = pairs.groupBy("_id", "_th", "_at").agg(F.collect_set(F.struct((2 * F.col("_m") / (F.col("_a") + F.col("_b"))).alias("c"), F.col("_name").alias("name"))).alias("_all"))
    near = near.select("_id", "_th", "_at", F.array_max("_all")["c"].alias("_c"), "_all").select("_id", "_th", "_at", "_c", F.transform(F.filter("_all", lambda x: x["c"] == F.col("_c")), lambda x: x["name"]).alias("_some"))
    found = near.groupBy("_id", "_th").agg(F.count_distinct("_at").alias("_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_some")))).alias("_names"), F.max("_c").alias("_best")).withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    base = rows.select("_id", "_th")
    out = base.join(found, base["_id"].eqNullSafe(F.col("_fid")) & (base["_th"] == F.col("_fth")), "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("_n", F.lit(0)).cast("long").alias("n_passages"), F.coalesce(F.array_join("_names", ","), F.lit("")).alias("licenses"), F.col("_best").alias("best"))


def sql(tenths: int = TENTHS) -> str:
    """The same in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, [{', '.join(map(quote, b))}])" for name, b in template_passages())
    return rf"""
WITH tpl AS (SELECT name, t, len(t) AS b FROM (VALUES {values}) v(name, t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
par AS (SELECT rid, norm, regexp_split_to_array(norm, '\n ?\n[ \n]*') AS ps FROM d),
raw AS (SELECT rid, list_concat(string_split(norm, chr(10)), list_filter(ps, lambda p: contains(p, chr(10))), CASE WHEN len(ps) > 1 THEN [norm] ELSE [] END) AS l FROM par),
pas AS (SELECT rid, pos, trim(regexp_replace(p, '[ \n]+', ' ', 'g')) AS p FROM (SELECT rid, unnest(l) AS p, unnest(range(len(l))) AS pos FROM raw)),
bg AS (SELECT rid, pos, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT rid, pos, string_split(p, ' ') AS w FROM pas)),
sized AS (SELECT rid, pos, g, len(g) AS a, name, t, b FROM bg JOIN tpl ON len(g) > 0 AND 20 * least(len(g), b) >= {tenths} * (len(g) + b) WHERE list_has_any(g, t)),
m AS (SELECT *, list_sum(list_transform(list_distinct(list_intersect(g, t)), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(t, lambda y: y = x))))) AS m FROM sized),
near AS (SELECT rid, pos, name, 2 * m / (a + b) AS c FROM m WHERE 20 * m >= {tenths} * (a + b) QUALIFY c = max(c) OVER (PARTITION BY rid, pos)),
f AS (SELECT rid, count(DISTINCT pos) AS n, array_to_string(list_sort(list(DISTINCT name)), ',') AS names, max(c) AS best FROM near GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::bigint AS n_passages, coalesce(names, '') AS licenses, best::double AS best FROM d LEFT JOIN f USING (rid)
"""

"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of the documents are joined to the positions of
the same grams in the license templates.  A document that holds a template
word for word puts all its matches on one diagonal (position in the document
less position in the template); inserted or lost words move the rest to a
neighbouring one.  Votes are counted by diagonal, neighbouring diagonals are
merged into spans, and each span is verified by the edit distance of its text
to the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from karstline.llm.common import checkpoint, named, read_table

GRAM_WORDS = 3
#: Diagonals this far apart at most, with at most GAP_WORDS between their matches, are one span.
DIAGONALS, GAP_WORDS = 4, 12
#: Share of a template's grams that must vote for a span.
VOTES = 0.2
#: Share of a template's characters that a span must have right.
SIMILARITY = 0.75
#: Score of a document with base phrases but no verified span.
BASE_SCORE = 0.6
#: Spans whose documents are broadcast at most (under 64 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000

# Phrases of the base labels, public license notices and texts (without titles and names).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
        Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
        Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
        In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
]

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the alphanumeric rule.

    ``lower`` also folds letters beyond A-Z; no folded letter but the Kelvin sign
    becomes ASCII, so with that one out of the way phrases match as if only A-Z
    were folded, and the number of words is the same.
    """
    folded = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(folded, _BREAKS), "")


def grams(rows: DataFrame, w: str, k: int) -> DataFrame:
    """The rows once for each k words of ``w`` that follow one another: adds ``pos`` and ``gram``, their hash.

    The words are a column of their own, so nothing is split again, and the
    generator, the hash and the join behind it are one generated function.
    """
    exploded = rows.select("*", F.posexplode(w).alias("pos", "__word"))
    gram = F.xxhash64("__word", *[F.get(w, F.col("pos") + j) for j in range(1, k)])
    return exploded.where(F.col("pos") <= F.size(w) - k).withColumn("gram", gram).drop("__word")


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """``(template, label, words)``; as large as the list of templates, whatever the corpus."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    return spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", words(F.col("text")).alias("t_words"))


def _key(id_col: str, text_col: str) -> list[Column]:
    # rows with one id and one text have one result
    return [named(id_col).alias("id"), F.xxhash64(F.coalesce(named(text_col), F.lit(""))).alias("hash")]


def _stands(parts: list[str]):
    """Whether the words of a phrase stand at a place of ``w``."""

    def here(i: Column) -> Column:
        hit = F.col("w")[i] == parts[0]
        for j, part in enumerate(parts[1:], 1):
            hit = hit & (F.col("w")[i + j] == part)
        return hit

    return here


def _fits(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def find_spans(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM_WORDS
) -> DataFrame:
    """Verified spans ``(id, hash, label, first_word, after_word, votes, similarity)``.

    Several places of one license are several spans; a span has the votes of at
    least ``VOTES`` of its template's grams.  Templates of under ``k`` words match
    nothing; null and empty texts have no spans.
    """
    table = template_table(docs.sparkSession, TEMPLATES if templates is None else templates)
    positions = grams(table, "t_words", k).select("template", F.size("t_words").alias("t_size"), F.col("pos").alias("t_pos"), "gram")
    placed = grams(docs.select(*_key(id_col, text_col), words(named(text_col)).alias("w")), "w", k).select("id", "hash", "pos", "gram")
    matches = placed.join(F.broadcast(positions), "gram").select("id", "hash", "template", "t_size", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    votes = matches.groupBy("id", "hash", "template", "t_size", "diagonal").agg(F.countDistinct("pos").alias("votes"), F.min("pos").alias("first"), (F.max("pos") + k).alias("after"))
    one = Window.partitionBy("id", "hash", "template").orderBy("first", "diagonal")
    apart = (F.col("first") - F.lag("after").over(one) > GAP_WORDS) | (F.abs(F.col("diagonal") - F.lag("diagonal").over(one)) > DIAGONALS)
    runs = votes.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(one))
    spans = runs.groupBy("id", "hash", "template", "t_size", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"))
    spans = spans.where(F.col("votes") >= VOTES * (F.col("t_size") - k + 1))
    spans = checkpoint(spans.select("id", "hash", "template", "votes", F.greatest("lo", F.lit(0)).alias("first_word"), (F.col("hi") + F.col("t_size")).alias("after_word")))

    keyed = docs.select(*_key(id_col, text_col), named(text_col).alias("text"))
    spans = _fits(spans.withColumnsRenamed({"id": "s_id", "hash": "s_hash"}))
    told = keyed.join(spans, keyed["id"].eqNullSafe(spans["s_id"]) & (keyed["hash"] == spans["s_hash"])).join(F.broadcast(table), "template")
    told = told.withColumn("w", words(F.col("text"))).withColumn("after_word", F.least("after_word", F.size("w")))
    part = F.array_join(F.slice("w", F.col("first_word") + 1, F.col("after_word") - F.col("first_word")), " ")
    whole = F.array_join("t_words", " ")
    right = 1 - F.levenshtein(part, whole) / F.greatest(F.length(part), F.length(whole))
    return told.select("id", "hash", "label", "first_word", "after_word", "votes", right.alias("similarity")).where(F.col("similarity") >= SIMILARITY).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and labels of every whole text: a row for each input row.

    Returns ``id_col, n_words, n_base, first_word, last_word long`` (places of the
    base phrases; null if none), ``base_labels, labels string`` (distinct, sorted,
    comma-joined; labels also those of verified spans) and ``score double``, the
    best span's similarity, or ``BASE_SCORE`` for base phrases alone, or 0.  A null
    text is empty; null and repeated ids are scanned like any; other columns are
    left out.
    """
    found = find_spans(docs, templates, id_col=id_col, text_col=text_col)
    spans = found.groupBy(F.col("id").alias("s_id"), F.col("hash").alias("s_hash")).agg(F.collect_set("label").alias("found"), F.max("similarity").alias("best"))
    spans = _fits(checkpoint(spans))
    every_word = sorted({w for phrase in PHRASES for w in phrase.split()})
    folded = F.lower(named(text_col))
    # a text without a phrase's words can't have the phrase
    rows = docs.select(*_key(id_col, text_col), words(named(text_col)).alias("w"), *[F.contains(folded, F.lit(w)).alias(f"has_{i}") for i, w in enumerate(every_word)])
    none = F.array().cast("array<int>")
    places, labels = [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        size = F.size("w") - len(parts)
        may = size >= 0
        for part in parts:
            may = may & F.col(f"has_{every_word.index(part)}")
        at = F.when(may, F.filter(F.sequence(F.lit(0), size), _stands(parts))).otherwise(none)
        places.append(at)
        labels.append(label)
    rows = rows.select("id", "hash", F.size("w").cast("long").alias("n_words"), *[p.alias(f"p{i}") for i, p in enumerate(places)])
    every = F.concat(*[F.col(f"p{i}") for i in range(len(places))])
    base = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(labels)]))
    rows = rows.select("id", "hash", "n_words", every.alias("every"), F.array_sort(F.array_distinct(base)).alias("base"))
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["s_id"]) & (rows["hash"] == spans["s_hash"]), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select(
        F.col("id").alias(id_col), "n_words", F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"), F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.coalesce("best", F.when(F.size("every") > 0, F.lit(BASE_SCORE)), F.lit(0.0)).alias("score"),
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of op4_licenses that SQL can express."""
    return op4_licenses(spark, sf_dir).select(*BASE)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
hits AS (
  SELECT w.doc_id, i - 1 AS place, label
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) AS w,
    (VALUES ('mit license', 2, 'mit'), ('apache license', 2, 'apache'), ('general public license', 3, 'gpl')) AS p(phrase, size, label)
  WHERE w.w[i] = split_part(phrase, ' ', 1) AND array_to_string(w.w[i:i + size - 1], ' ') = phrase),
found AS (
  SELECT doc_id, count(*) AS n, min(place) AS first, max(place) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  coalesce(labels, '') AS base_labels
FROM w LEFT JOIN found USING (doc_id)
"""

QUERIES = {"op4_licenses": op4_licenses, "licenses_base": licenses_base}
ORACLES: dict[str, str] = {"licenses_base": ORACLE}

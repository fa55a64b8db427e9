"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Words are the folded words of the text, shingles `shingle` consecutive words (a template of fewer words is one shingle of its own
length). For a template of T shingles, windows of 2 T shingle places every T places cover each text, so a whole copy lies in one
of them. A window is signed with `bands` bands of one row each, the least hash of *all* its distinct shingles in each band, and retrieves
the templates that have the same value in the same band. At containment 0.8 window and template have a Jaccard similarity of
at least 0.8 / 2.2 = 0.36, and 24 bands miss that with probability 0.64^24 < 3e-5. Each window and template retrieved
are then verified: the share of the template's distinct shingles in the window must reach `min_containment`.

A window can only equal a template in a band if it holds the very shingle whose hash is that template's least. So one pass over all
places marks those of these few shingles (`bands` a template at most), and only windows around them are signed: the others would retrieve
nothing. Templates are a table of any size: what meets the places is broadcast while it is short, and shuffled beyond; lengths of
templates are data, not plans.

Null and empty texts, and texts shorter than every template, have no licenses. Texts of any length are whole. Null names and wordless
templates match nothing; templates may share a name, which a text then has if one of them matches; equal templates count once. Rows equal in id and text
share a result. Empty tables give no rows, an empty table of templates no licenses. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybox.llm.common import LOWER, UPPER, cut, few, folded_words, row_key

#: License notices and short licenses, as they stand in the public texts of these licenses.
NOTICES = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NOTICES.items()), "name string, text string")


def _shingles(words, k):
    """Hashes of all runs of k words of an array, in order; none if it has fewer."""
    places = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda s: F.xxhash64(F.translate(F.array_join(F.slice(words, s, k), " "), UPPER, LOWER)))


def _signature(shingles, bands: int):
    """The least hash of the shingles in each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, b))))


def scan_licenses(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  name_col: str = "name", template_col: str = "text", shingle: int = 5,
                  min_containment: float = 0.8, bands: int = 24) -> DataFrame:
    """One row per document: id, n_licenses, licenses (sorted names), spans (first word, name, words, containment)."""
    t = templates.select(F.col(name_col).cast("string").alias("name"), folded_words(template_col).alias("w")).filter("name is not null and size(w) > 0")
    t = t.withColumn("k", F.least(F.lit(shingle), F.size("w"))).withColumn("sh", _shingles(F.col("w"), F.col("k")))
    t = t.select("name", "k", F.size("sh").alias("step"), F.array_distinct("sh").alias("sh"), F.xxhash64("name", "sh").alias("tid"))
    t = cut(t.dropDuplicates(["tid"]).withColumn("values", _signature(F.col("sh"), bands)))
    signed = few(t.select("tid", "k", "step", F.posexplode("values").alias("band", "value")))
    needles = t.select("k", "step", "values", F.explode("sh").alias("sh")).filter(F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64("sh", b) == F.get("values", b)))
    needles = few(needles.select("k", "step", "sh").distinct())
    words = docs.select(*row_key(id_col, text_col), folded_words(text_col).alias("w"))
    marked = []
    for k in sorted(r.k for r in t.select("k").distinct().collect()):  # 1 to `shingle`
        places = words.filter(F.size("w") >= k).select("_k1", "_k2", "w", F.posexplode("w").alias("pos", "x"))
        gram = F.translate(F.concat_ws(" ", *[F.col("x"), *[F.get("w", F.col("pos") + j) for j in range(1, k)]]), UPPER, LOWER)
        marked.append(places.filter(F.col("pos") + k <= F.size("w")).select("_k1", "_k2", "pos", F.xxhash64(gram).alias("sh"))
                      .join(needles.filter(F.col("k") == k), "sh").select("_k1", "_k2", "k", "step", F.floor(F.col("pos") / F.col("step")).alias("at")))
    base = docs.select(F.col(id_col), *row_key(id_col, text_col))
    kind = "array<struct<first:int,name:string,words:int,containment:double>>"
    if not marked:
        per = base.select("_k1", "_k2", F.array().cast(kind).alias("spans")).limit(0)
    else:
        windows = reduce(DataFrame.union, marked).select("_k1", "_k2", "k", "step", F.explode(F.array("at", F.col("at") - 1)).alias("win")).filter("win >= 0")
        per_text = few(windows.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("k", "step", F.col("win").cast("int").alias("win"))).alias("windows")), "windows")
        signs = words.join(per_text, ["_k1", "_k2"]).select("_k1", "_k2", "w", F.explode("windows").alias("_w")).select("_k1", "_k2", "w", "_w.*")
        signs = signs.select("_k1", "_k2", "k", "step", "win", F.slice("w", F.col("win") * F.col("step") + 1, 2 * F.col("step") + F.col("k") - 1).alias("part"))
        signs = signs.select("_k1", "_k2", "k", "step", "win", _shingles(F.col("part"), F.col("k")).alias("shs"))
        signs = cut(signs.filter("size(shs) > 0"))
        keys = ["_k1", "_k2", "k", "step", "win"]
        met = (signs.select(*keys, F.posexplode(_signature(F.array_distinct("shs"), bands)).alias("band", "value"))
               .join(signed, ["k", "step", "band", "value"]).select(*keys, "tid").distinct())
        shingles = few(t.select("tid", "name", F.size("sh").alias("total"), F.explode("sh").alias("sh")))
        held = (signs.join(met, keys).select(*keys, "tid", F.posexplode("shs").alias("i", "sh")).join(shingles, ["tid", "sh"])
                .groupBy(*keys, "tid", "name", "total").agg(F.countDistinct("sh").alias("n"), F.min("i").alias("i"), F.max("i").alias("j"))
                .withColumn("containment", F.col("n") / F.col("total")).filter(F.col("containment") >= min_containment))
        spans = held.select("_k1", "_k2", "name", (F.col("win") * F.col("step") + F.col("i")).cast("int").alias("first"), (F.col("j") - F.col("i") + F.col("k")).alias("words"), "containment")
        one = spans.groupBy("_k1", "_k2", "name", "first").agg(F.max("words").alias("words"), F.max("containment").alias("containment"))
        per = one.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("first", "name", "words", "containment"))).alias("spans"))
    return (base.join(per, ["_k1", "_k2"], "left").select(F.col(id_col), F.coalesce("spans", F.array().cast(kind)).alias("spans"))
            .withColumn("licenses", F.array_sort(F.array_distinct(F.col("spans.name"))))
            .withColumn("n_licenses", F.size("licenses").cast("long")))

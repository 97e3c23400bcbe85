"""License notices in documents: MinHash bands over overlapping windows, then exact containment.

A template of ``t`` shingles belongs to the length class ``L``, the least power of two that
is at least ``t``.  Documents are seen through windows of ``2 L`` shingles at every ``L``th, so
each copy of the template lies whole in one window, and its Jaccard similarity with that
window is at least ``t / 2L > 1/4`` (0.19 where a fifth of the template is changed).  Bands
have one row each, so a window meets the template with probability at least
``1 - (1 - 0.19)^48 > 0.9999``.  What a band retrieves is verified by exact containment of the
template's shingles.

A band can only match a window that holds the shingle which is the template's minimum in
that band.  So signatures are made only for windows that hold one of these few shingles;
this loses no band match.  Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import row_hash

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8
#: Templates, and characters of templates, that one pass over the documents looks for at most;
#: further ones take further passes.  Bands (48 numbers a template) and shingles are broadcast apart.
BLOCK_TEMPLATES, BLOCK_CHARS = 200, 2_000_000

#: Notices and openings of well-known licenses, by name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9\\u0080-\\uffff]+"), lambda w: w != "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` and its lambdas use it."""
    return F.transform(F.array(value), body).getItem(0)


def _starts(words: Column) -> Column:
    """0-based starts of the shingles; none for fewer words than a shingle has."""
    return F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column) -> Column:
    return _let(words, lambda w: F.transform(_starts(w), lambda i: F.xxhash64(F.slice(w, i + 1, SHINGLE))))


def _shingles(words: Column) -> Column:
    return _let(words, lambda w: F.array_distinct(F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))))


def _signature(hashes: Column) -> Column:
    """Minima under 48 orders of the hashes, each made by flipping the bits of its seed."""
    seeds = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b))
    return _let(hashes, lambda own: F.transform(seeds, lambda s: F.array_min(F.transform(own, lambda h: h.bitwiseXOR(s))).bitwiseXOR(s)))


def _windows(place: Column, length: int) -> Column:
    """The two windows of a class that hold a place; the first place has one."""
    return F.transform(F.array(F.lit(0), F.lit(1)), lambda back: F.struct(F.lit(length).alias("length"), F.greatest(F.floor(place / length).cast("int") - back, F.lit(0)).alias("k")))


def prepare_templates(templates: DataFrame) -> DataFrame:
    """license_id, shingles, n, length (class), signature of the templates that have a shingle.

    Null texts and texts below five words have none; repeated templates stay apart; an
    empty table gives none; other columns are ignored.
    """
    words = templates.select("license_id", _words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    out = words.select("license_id", _shingles(F.col("w")).alias("shingles"), F.array_distinct(_hashes(F.col("w"))).alias("h"), (F.size("w") - SHINGLE + 1).alias("t"))
    return out.select("license_id", "shingles", F.size("shingles").alias("n"), F.pow(F.lit(2), F.ceil(F.log2(F.col("t")))).cast("int").alias("length"), _signature(F.col("h")).alias("signature"))


def _blocks(templates: DataFrame) -> Iterator[list[Row]]:
    """Prepared templates in blocks.  They come to the driver one partition at a time."""
    block, size = [], 0
    for r in prepare_templates(templates.select("license_id", "text")).toLocalIterator():
        own = sum(map(len, r["shingles"])) // SHINGLE
        if block and (len(block) >= BLOCK_TEMPLATES or size + own > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append(r)
        size += own
    if block:
        yield block


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """One row per document row and license found: doc_id, license_id, containment, start_word, row.

    ``containment`` is the share of the template's distinct shingles of five words that the
    best window holds, ``start_word`` the first word of that window.  Null, empty and
    shorter texts match nothing; templates below five words are never found; repeated
    rows count once per identifier and text; without templates there are no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("row"), _words(text).alias("w"))
    rows = rows.select("doc_id", "row", "w", _hashes(F.col("w")).alias("h"))
    found = [_scan_block(rows, block, containment) for block in _blocks(templates)]
    if not found:
        return spark.createDataFrame([], "doc_id long, license_id string, containment double, start_word int, row binary")
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "row", "license_id").agg(F.max(F.struct("containment", (-F.col("start_word")).alias("at"))).alias("best"))
    return best.select("doc_id", "license_id", F.col("best.containment").alias("containment"), (-F.col("best.at")).alias("start_word"), "row")


def _scan_block(rows: DataFrame, block: list[Row], containment: float) -> DataFrame:
    """Windows that hold a template of the block: doc_id, row, license_id, containment, start_word."""
    spark = rows.sparkSession
    minima = sorted({x for r in block for x in r["signature"]})
    lengths = sorted({r["length"] for r in block})
    bands = spark.createDataFrame([(t, r["length"], b, x) for t, r in enumerate(block) for b, x in enumerate(r["signature"])], "template int, length int, band int, least long")
    known = spark.createDataFrame([(t, r["license_id"], r["shingles"], r["n"]) for t, r in enumerate(block)], "template int, license_id string, shingles array<string>, n int")
    rows = rows.where(F.arrays_overlap("h", F.array(*map(F.lit, minima)).cast("array<long>")))
    # Places of the few shingles, then the two windows of each class that hold the place.
    places = F.filter(F.transform("h", lambda h, i: F.when(h.isin(minima), i)), lambda i: i.isNotNull())
    windows = F.array_distinct(F.flatten(F.transform(places, lambda p: F.flatten(F.array(*[_windows(p, n) for n in lengths])))))
    seen = rows.withColumn("window", F.explode(windows)).select("doc_id", "row", F.col("window.length").alias("length"), (F.col("window.k") * F.col("window.length")).alias("start_word"), "w", "h")
    seen = seen.select("doc_id", "row", "length", "start_word", F.slice("w", F.col("start_word") + 1, F.col("length") * 2 + SHINGLE - 1).alias("w"), _signature(F.slice("h", F.col("start_word") + 1, F.col("length") * 2)).alias("signature"))
    met = seen.select("doc_id", "row", "length", "start_word", "w", F.posexplode("signature").alias("band", "least")).join(F.broadcast(bands), ["length", "band", "least"])
    met = met.dropDuplicates(["row", "length", "start_word", "template"]).join(F.broadcast(known), "template")
    share = F.size(F.array_intersect("shingles", _shingles(F.col("w")))) / F.col("n")
    return met.withColumn("containment", share).where(F.col("containment") >= containment).select("doc_id", "row", "license_id", "containment", "start_word")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license_id string, text string")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_templates(spark)).drop("row")

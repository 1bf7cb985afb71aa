"""License scan in DataFrame functions only: MinHash bands over overlapping windows retrieve templates, containment verifies.

Texts and templates become sequences of five-word shingle hashes (words lower-cased, cut at anything but letters and digits).
Templates are a table of shingles; joined with the texts' shingles it leaves the few that a template has, and nothing else of a text
is carried on. A template of s shingles belongs to the class c, the power of two from s up. A text's windows of that class hold 2c
shingles and start every c/2, so a copy of the template, even one with half again as many words, lies whole in one of them. A
window counts by the shingles in it that templates of its class have; with 0.8 of a template it resembles that template by
0.8 s / (2c + 0.2 s) > 0.18 or more. Each band is one minimum, so BANDS of them miss such a window with a chance below
0.82^BANDS = 0.0001. A window with fewer such shingles than 0.8 of the shortest template of its class holds none: only windows with
as many get bands.

Retrieved pairs are then judged by the exact share of the template's shingles in the window.

Defined results: null or empty texts, or fewer than five words, match nothing; several windows of a text that match a template
are one row, with the first of the best (ties: the earlier start); repeated rows (same id, same text) are one row, rows that repeat an
id with another text are scanned each; null doc_id: like any other id; very long texts are scanned whole; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, stash

WORDS = 5
LEAST = 0.8
BANDS = 48
#: Numbers in a template table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST = 1_000_000

# License notices, the passages that tell a license from its relatives, and (license_texts/) whole licenses. No two
# of different licenses share 0.8 of the shorter one's shingles, so a passage that differs in a word or a version is short.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "GNU General Public License, version 2",
    "GPL-3.0-notice": "GNU General Public License, version 3",
    "LGPL-2.1-notice": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-notice": "GNU Lesser General Public License, version 3",
    "AGPL-3.0-notice": "GNU Affero General Public License, version 3",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-2.1": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES |= {f"CC-{k}-{v}-short": f"under CC {k} {v}" for k in _CC for v in ("1.0", "2.0", "2.5", "3.0", "4.0")}
TEMPLATES |= {f"CC-{k}-{v}-notice": f"This work is licensed under a Creative Commons {name} {v} {where} License." for k, name in _CC.items() for v, where in (("3.0", "Unported"), ("4.0", "International"))}
BODIES = {f"{f.stem}-text": f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
KNOWN = TEMPLATES | BODIES


def shingles(text: Column) -> Column:
    """Hashes of the five-word shingles of a text, in order."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - WORDS)
        return F.when(F.size(w) < WORDS, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WORDS)))))

    return let(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), hashed)


def bands(s: Column) -> Column:
    """BANDS structs (band, value) of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(s, lambda x: F.xxhash64(x, b))).alias("value")))


def templates(spark: SparkSession, texts: dict[str, str] = KNOWN) -> DataFrame:
    """license, own (distinct shingles), class of every template with five words or more."""
    rows = spark.createDataFrame([*texts.items()], "license string, text string")
    return rows.select("license", F.array_distinct(shingles(F.col("text"))).alias("own")).where(F.size("own") > 0).withColumn("class", F.expr("CAST(power(2, ceil(log2(size(own)))) AS INT)"))


def _small(table: DataFrame, numbers: str = "1") -> DataFrame:
    """A written table, to be broadcast if the numbers that it holds, counted, allow it."""
    return F.broadcast(table) if (table.agg(F.sum(F.expr(numbers))).first()[0] or 0) <= BROADCAST else table


def starts(i: Column, c: Column) -> Column:
    """Starts of the windows of class c, four at most, that hold shingle i."""
    step = F.greatest(F.lit(1), (c / 2).cast("int"))
    first = F.ceil(F.greatest(F.lit(0), i - 2 * c + 1) / step).cast("int")
    return F.transform(F.sequence(first, F.floor(i / step).cast("int")), lambda k: k * step)


def scan(docs: DataFrame, texts: dict[str, str] = KNOWN, least: float = LEAST) -> DataFrame:
    """doc_id, license, containment, start and end (shingle numbers of the first best window) of every license in every text."""
    known = stash(templates(docs.sparkSession, texts))
    need = known.groupBy("class").agg(F.ceil(least * F.min(F.size("own")) - 1e-6).alias("need"))
    vocabulary = stash(known.select("class", F.explode("own").alias("x")).distinct().join(need, "class"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(shingles(F.col("text"))).alias("i", "x"))
    hits = hashed.join(_small(vocabulary), "x").select("doc_id", "t", "class", "need", "i", "x", F.explode(starts(F.col("i"), F.col("class"))).alias("start"))
    # A hit goes to its windows and never meets the others of its text, so a long text costs in proportion to its hits.
    windows = hits.groupBy("doc_id", "t", "class", "need", "start").agg(F.collect_set(F.struct("i", "x")).alias("inside")).where(F.size("inside") >= F.col("need"))
    windows = windows.select("doc_id", "t", "class", "start", (F.array_max("inside.i") + 1).alias("end"), F.array_sort(F.array_distinct("inside.x")).alias("window"))
    # Of a text's windows with the same shingles the first stands for all, as it is the one that would be reported.
    windows = windows.groupBy("doc_id", "t", "class", "window").agg(F.min(F.struct("start", "end")).alias("w")).select("doc_id", "t", "class", "window", "w.*")
    banded = stash(windows).select("*", F.explode(bands(F.col("window"))).alias("b")).select("doc_id", "t", "class", "start", "end", "window", "b.*")
    wanted = stash(known.select("license", "class", F.explode(bands(F.col("own"))).alias("b")).select("license", "class", "b.*"))
    pairs = banded.join(_small(wanted), ["class", "band", "value"]).join(_small(known.select("license", "own"), "size(own)"), "license")
    share = F.size(F.array_intersect("window", "own")) / F.size("own")
    judged = pairs.select("doc_id", "t", "license", "start", "end", share.alias("containment")).where(F.col("containment") >= least)
    best = judged.groupBy("doc_id", "t", "license").agg(F.min(F.struct((-F.col("containment")).alias("c"), "start", "end")).alias("x"))
    return best.select("doc_id", "license", (-F.col("x.c")).alias("containment"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

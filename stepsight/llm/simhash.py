"""SimHash near-dedup through a segment-popcount embedding.

A fingerprint's 64 bits fall into 32 segments of two bits; its embedding is the bit count of each. The Manhattan distance
of two embeddings is a lower bound of the fingerprints' Hamming distance. The segments fall into three parts. If the distance is at
most 4, the two parts with the smaller shares of it differ by 2 or less together, so the fingerprints meet in one of three grids,
each over the 21 or 22 bit counts of two parts: a point lies in its own cell and in those one step up or down, and two such balls
meet whenever the distance is at most 2. Cells are joined by equality and the Hamming distance is checked in the join's condition,
so the method is exact. A cell of random fingerprints is told by about 30 bits: cells hold strangers only beyond some 10^8 texts.
Cells with one fingerprint alone, nearly all, are left after one count.

Near copies would make pairs quadratic in a group's size. Only connectivity is asked for, hence two passes: links of each
cell's members to the cell's smallest fingerprint, then links between different components only.

Defined results: null or empty text, or no word: fingerprint zero, linked like any other; fewer words than the shingle's
length: the whole sequence is the one shingle; a bit set in just half the hashes (a tie) is 0; very long texts are read whole, in
pieces; repeated rows share a component; null doc_id: ignored when the smallest id is taken; empty table: no rows; other columns,
whatever their names, are ignored by near_duplicates and kept by one_per_group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stash

SHINGLE = 4
SEED = 42
DISTANCE = 4


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not w:
        return 0
    n, sums = max(1, len(w) - k + 1), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounds memory for very long texts
        part = w[at : at + (1 << 16) + k - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(k)))) if len(w) >= k else [b" ".join(w)]
        h = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], "<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint: the fingerprint's 64 bits) and h (a hash of the text) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(x.as_py()) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "h"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(batches, f"doc_id {kind}, fp bigint, h bigint")


#: Fingerprints that one task places in cells at most, about.
SPREAD = 50_000
#: Segments of each part: the two parts of a grid make its cells.
PARTS = (range(0, 11), range(11, 22), range(22, 32))


def cells(points: DataFrame) -> DataFrame:
    """One row (columns of points, cell) for each grid cell of each fingerprint. A cell's number has the bit counts in two bits each, the
    places of the part that its grid leaves out all set (no count is 3); a step is between 0 and 1 or between 1 and 2."""
    own = points.columns
    both, one = (f"((fp {sign} shiftrightunsigned(fp, 1)) & {0x5555555555555555}L)" for sign in "&^")
    counted = points.selectExpr(*own, f"shiftleft({both}, 1) | {one} AS counts")
    around = []
    for part in PARTS:
        left_out = sum(3 << 2 * i for i in part)
        left_out -= (left_out >> 63) << 64
        steps = f"array({', '.join(f'{1 << 2 * i}L' for other in PARTS if other is not part for i in other)})"
        rest = f"(counts | {left_out}L)"
        zero_one = f"transform(filter({steps}, s -> (shiftrightunsigned(counts, 1) & s) = 0), s -> {rest} ^ s)"
        one_two = f"transform(filter({steps}, s -> ((counts | shiftrightunsigned(counts, 1)) & s) <> 0), s -> {rest} ^ (s | shiftleft(s, 1)))"
        around += [f"array({rest})", zero_one, one_two]
    return counted.selectExpr(*own, f"explode(concat({', '.join(around)})) AS cell")


def linked(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints of `fps`: components of those at DISTANCE or fewer bits."""
    near = F.expr(f"bit_count(a ^ b) <= {DISTANCE}")
    points = stash(fps.select("fp").distinct())
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count() // SPREAD)
    placed = cells(points.repartition(parts, "fp"))  # a point makes about a hundred rows
    shared = placed.groupBy("cell").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b < last").select("cell", "b")
    met = stash(placed.join(stash(shared).hint("merge"), "cell"))  # these grow with the fingerprints: never broadcast
    first = components(met.select(F.col("fp").alias("a"), "b").where((F.col("a") != F.col("b")) & near).distinct())
    rooted = stash(points.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    again = met.select("fp", "cell").join(rooted, "fp")
    mixed = stash(again.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell"))
    again = stash(again.join(mixed, "cell"))
    a, b = (again.select(F.col("cell").alias(f"cell_{x}"), F.col("fp").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    across = a.join(b, (F.col("cell_a") == F.col("cell_b")) & (F.col("root_a") < F.col("root_b")) & near)
    merged = components(across.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left").select("fp", F.coalesce("final", "root").alias("root"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, h, root (a fingerprint that names the component) and component_id (its smallest doc_id) of every row of docs."""
    fps = stash(fingerprints(docs))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = stash(linked(classes))
    ids = roots.join(classes, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(roots.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, h and component_id (smallest doc_id of the component; null where all are null) of every row of docs."""
    return grouped(docs).select("fp", "doc_id", "h", "component_id")


def one_per_group(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id (nulls last; of its repeats: the smallest text hash, then any one).
    found: doc_id, h and root of every row, by default those of grouped()."""
    keep = (grouped(docs) if found is None else found).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.h").alias("kept_h"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    kept = own.join(keep, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return kept.dropDuplicates(["id", "h"]).select("doc.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

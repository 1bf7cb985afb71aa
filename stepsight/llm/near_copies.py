"""Near copies: SimHash, and on top of its components a similarity join of what its 4 bits of 64 are too few for.

SimHash is operator 2 itself (simhash.grouped): texts whose fingerprints differ in 4 or fewer bits are one component from the start, so
no link of operator 2 is lost. The join then links texts whose sets of five-word shingles resemble each other by LEAST (Jaccard) or more
and that SimHash left apart; it compares no two texts of one component.

MinHash bands retrieve, the shingle sets themselves verify. A band is the minimum of ROWS hash functions each; a pair at a
similarity of 0.8 shares none of BANDS bands with a chance of (1 - 0.8^ROWS)^BANDS = 0.00003, and of pairs below none is linked.
Only connectivity is asked for, hence passes as in simhash: links of each text to the smallest text that shares a band value, then
to the smallest one of each of its band values, then to PIVOTS of them spread by hash, then all links; from the second on between
different components only. A crowd whose links are many is mostly one component before the last pass.

The last two passes meet texts that share a band value and are no copies of its smallest text, so a group of texts a little less alike
than 0.8 would make a pair of each two. There the join's condition holds sketches against each other, one bit of each of SKETCH further
minima: at a similarity of 0.8 a tenth of the bits differ, and 4.6 deviations more are let through (of such pairs 0.000002 are lost). Only
what passes becomes a row, and only in the smallest of the band values that the two share, so each pair is one row without a count of
its copies (two texts at 0.75 share six values); then its shingle sets are fetched.

Defined results: words as in simhash; null or empty text, or no word: copies of each other; fewer words than a shingle: the whole
sequence is the one shingle; equal texts are one node; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stash
from .simhash import grouped, one_per_group

WORDS, LEAST = 5, 0.8
ROWS, BANDS, SEED = 4, 20, 42
SKETCH = 1024
#: Texts of a band value that all others of it are held against before the last pass, at most.
PIVOTS = 64
#: Bits of two sketches that may differ: the mean at LEAST and 4.6 deviations.
FAR = int(SKETCH * (1 - LEAST) / 2 + 4.6 * (SKETCH * (1 - LEAST) / 2 * (1 + LEAST) / 2) ** 0.5) + 1
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 63, (2, ROWS * BANDS, 1), dtype=np.uint64)
_SMALL = np.random.default_rng(SEED + 1).integers(0, 1 << 31, (2, SKETCH, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FACTORS, _SUMMANDS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: str | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else [b" ".join(w)] if w else []
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """BANDS hashes, each with its band's number in it."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1 << 13):
        least = np.minimum(least, (_FACTORS * own[at : at + (1 << 13)] + _SUMMANDS).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _sketches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = [shingles(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["h", "n", "bands"])


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH bits of a set of shingles in 64-bit numbers: one of each of as many minima."""
    x = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 1 << 12):
        least = np.minimum(least, (_SMALL[0] * x[at : at + (1 << 12)] + _SMALL[1]).min(1))
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31) == 1, bitorder="little").view(np.int64)


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x.as_py()).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], ["h", "own"])


def _bits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        sets = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in b.column(1))
        both = [(sketch(s), bands(s)) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in both], pa.list_(pa.int64())) for i in range(2))], ["h", "bits", "cells"])


def verified(own: DataFrame, pairs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of pairs (a, b: hashes of texts) whose texts resemble each other by `least`, by their shingle sets (h, own)."""
    a, b = (own.select(F.col("h").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    common, both = F.size(F.array_intersect("own_a", "own_b")), F.size("own_a") + F.size("own_b")
    shared = pairs.join(a, "a").join(b, "b").select(*pairs.columns, common.alias("common"), both.alias("both"))
    return stash(shared.where(F.col("common") >= least * (F.col("both") - F.col("common")) - 1e-9).select(*pairs.columns))


def _joined(rooted: DataFrame, links: DataFrame) -> DataFrame:
    """rooted (h, root) with the components that links (root_a, root_b) connect made one; frees what earlier passes shuffled."""
    merged = components(links.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    out = stash(rooted.join(merged.select(F.col("node").alias("root"), F.col("root").alias("final")), "root", "left").select("h", F.coalesce("final", "root").alias("root")))
    rooted.sparkSession.sparkContext._jvm.System.gc()
    return out


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of placed (cell, root, ...) in cells of more than one component."""
    cells = placed.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell")
    return placed.join(cells, "cell", "left_semi")


def begun(found: DataFrame) -> DataFrame:
    """(h, root) of the texts of simhash.grouped(): the smallest hash of a text's component."""
    own = found.select("h", F.col("root").alias("group")).distinct()
    return stash(own.join(own.groupBy("group").agg(F.min("h").alias("root")), "group").select("h", "root"))


def roots(texts: DataFrame, least: float = LEAST, rooted: DataFrame | None = None) -> DataFrame:
    """(h, root) of the distinct texts of `texts` (h: hash, text): components of those that resemble each other, and of those that `rooted`
    (the same columns, of every text) has as one already."""
    points = stash(texts.mapInArrow(_sketches, "h bigint, n int, bands array<bigint>").dropDuplicates(["h"]))
    rooted = points.select("h", F.col("h").alias("root")) if rooted is None else rooted
    placed = points.select("h", "n", F.explode("bands").alias("cell"))
    near = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    pivots = placed.groupBy("cell").agg(F.min(F.struct("h", "n")).alias("p"), F.count("*").alias("k")).where("k > 1").select("cell", F.col("p.h").alias("b"), F.col("p.n").alias("m"))
    met = stash(placed.join(pivots, "cell"))
    own = stash(texts.join(met.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"]).mapInArrow(_sets, "h bigint, own array<bigint>"))
    to_pivot = stash(met.where((F.col("h") != F.col("b")) & near).select(F.col("h").alias("a"), "b").distinct())

    def apart(pairs: DataFrame) -> DataFrame:
        """pairs with the roots of both, where they differ."""
        a, b = (rooted.select(F.col("h").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        return stash(pairs.join(a, "a").join(b, "b").where("root_a <> root_b"))

    one = to_pivot.groupBy("a").agg(F.min("b").alias("b"))  # most texts need no more than their smallest pivot
    rooted = _joined(rooted, verified(own, apart(one), least))
    rooted = _joined(rooted, verified(own, apart(to_pivot.join(one, ["a", "b"], "left_anti")), least))
    again = stash(_mixed(met.select("h", "n", "cell").join(rooted, "h")))
    few = own.join(again.select("h").distinct(), "h", "left_semi").mapInArrow(_bits, "h bigint, bits array<bigint>, cells array<bigint>")
    again = stash(again.join(few.select("h", "cells", *(F.col("bits")[i].alias(f"k{i}") for i in range(SKETCH // 64))), "h"))

    def alike(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs of texts in one cell, of different components, whose sketches are near enough."""
        a, b = (rows.select("cell", F.col("h").alias(x), F.col("n").alias(size), F.col("root").alias(f"root_{x}"), F.col("cells").alias(f"cells_{x}"), *(F.col(f"k{i}").alias(f"{x}{i}") for i in range(SKETCH // 64))) for rows, x, size in ((left, "a", "n"), (right, "b", "m")))
        close = F.expr(" + ".join(f"bit_count(a{i} ^ b{i})" for i in range(SKETCH // 64)) + f" <= {FAR}")
        once = F.array_min(F.array_intersect("cells_a", "cells_b")) == F.col("cell")  # roots differ, so each cell that both are in is mixed
        return a.join(b, "cell").where((F.col("root_a") != F.col("root_b")) & (F.col("a") < F.col("b")) & near & close & once).select("a", "b", "root_a", "root_b")

    known = to_pivot.select("b", "a").toDF("a", "b")  # a pivot is the smallest of its cell
    some = again.join(again.groupBy("cell", F.pmod(F.xxhash64("h"), F.lit(PIVOTS))).agg(F.min("h").alias("h")), ["cell", "h"], "left_semi")
    tried = stash(alike(again, some).union(alike(some, again)).distinct().join(known, ["a", "b"], "left_anti"))
    rooted = _joined(rooted, verified(own, tried, least))
    again = stash(_mixed(again.drop("root").join(rooted, "h")))
    return _joined(rooted, verified(own, stash(alike(again, again).join(known.union(tried.select("a", "b")), ["a", "b"], "left_anti")), least))


def keep_one(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Of each group of near copies, by SimHash and by resemblance, the row with the smallest doc_id, as in simhash.one_per_group."""
    found = stash(grouped(docs).select("doc_id", "h", "root"))
    texts = docs.select(F.xxhash64("text").alias("h"), "text")
    return one_per_group(docs, found.select("doc_id", "h").join(roots(texts, least, begun(found)), "h"))

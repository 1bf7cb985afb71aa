"""Embedding near-dedup by counting collisions in one-dimensional projections.

Unit vectors are projected on PROJECTIONS random directions. Two vectors collide in a projection if one lies in the window of
half-width WINDOW centred at the other. Vectors at the cosine threshold differ by a known length, so the number of their
collisions is binomial with a known chance: the count that a pair must reach is calibrated for RECALL at that worst case.
Pairs that reach it are verified by their cosine in double precision.

Vectors are sorted by the first projection and, by their rank there, cut into tiles of TILE, a row each; only tiles whose ranges
come within reach of each other meet, each two in one task. There, every projection is sorted into prefix bitmaps, a window is the
exclusive-or of two of them, and collisions of a query with 64 vectors at a time are added up in bit-sliced counters. Exact copies
are one class beforehand. A task returns sums of links and a spanning forest, never its pairs, so a large group costs rows in proportion
to its members. In high dimensions one projection rules out only part of the tile pairs: the number of comparisons stays
quadratic (about a nanosecond each); rows are two for each pair of tiles, some 10^7 times fewer than pairs of vectors.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors without an id, link
with nothing; vectors of different dimensions do not link; a cosine of just the threshold (a tie) links; repeated rows, also of one
vec_id, link with each other; very long vectors make smaller tiles; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, stash

COSINE = 0.95
PROJECTIONS = 32
WINDOW = 0.45
RECALL = 0.9999
TILE = 4096
#: Numbers that a tile holds at most.
NUMBERS = 1 << 22
SEED = 11
#: Buckets of a projection and their width: projections of unit vectors lie within -4 and 4 but for a few, which clip.
BUCKETS, WIDTH = 256, 1 / 32
#: Deviations of the first projection's difference within which tiles must come.
REACH = 4.5


def collision_chance(cosine: float, window: float = WINDOW) -> float:
    """Chance that two unit vectors at this cosine collide in one projection."""
    return math.erf(window / math.sqrt(2) / math.sqrt(2 - 2 * cosine))


def least_count(cosine: float = COSINE, m: int = PROJECTIONS, recall: float = RECALL) -> int:
    """The largest count that pairs at the cosine threshold reach with at least this chance."""
    p, below = collision_chance(cosine), 0.0
    for count in range(m + 1):
        below += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if below > 1 - recall:
            return count
    return m


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, m))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def windows(buckets: np.ndarray, half: int) -> np.ndarray:
    """For each bucket, as bits, which of the vectors in `buckets` lie in the window centred there."""
    n = len(buckets)
    held = np.zeros((BUCKETS + 1, -(-n // 64) * 64), bool)
    held[buckets.astype(np.int64) + 1, np.arange(n)] = True
    prefix = np.bitwise_xor.accumulate(np.packbits(held, axis=1, bitorder="little"), axis=0).view(np.uint64)
    at = np.arange(BUCKETS)
    return prefix[np.minimum(at + half, BUCKETS - 1) + 1] ^ prefix[np.maximum(at - half, 0)]


def colliding(queries: np.ndarray, tables: list[np.ndarray], least: int) -> np.ndarray:
    """Rows of bits: which vectors collide with each query at least `least` times. queries: buckets, one column a projection."""
    planes: list[np.ndarray] = []
    for j, table in enumerate(tables):
        carry = table[queries[:, j]]
        for k, plane in enumerate(planes):
            planes[k], carry = plane ^ carry, plane & carry
        if (j + 1).bit_length() > len(planes):
            planes.append(carry)
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], np.uint64(2**64 - 1))
    for k in reversed(range(len(planes))):
        if least >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more | same


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, cosine: float = COSINE, rows: int = 256):
    """Yields (i, j) index arrays of the verified pairs between unit vectors a and b (i < j if they are the same tile)."""
    lines = directions(a.shape[1])
    qa, qb = (np.clip(np.floor(x @ lines / WIDTH) + BUCKETS // 2, 0, BUCKETS - 1).astype(np.uint8) for x in (a, b))
    half, least = math.ceil(WINDOW / WIDTH), least_count(cosine)
    tables = [windows(qb[:, j], half) for j in range(qb.shape[1])]
    for at in range(0, len(a), rows):
        bits = colliding(qa[at : at + rows], tables, least)
        i, j = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(b)])
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        good = np.zeros(len(i), bool)
        for k in range(0, len(i), 50_000):
            part = slice(k, k + 50_000)
            good[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= cosine
        if good.any():
            yield i[good], j[good]


def _vectors(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _meet(table: pa.Table) -> pa.Table:
    """Of two tiles (or one with itself): rows (a, links) and rows (a, b) of a spanning forest."""
    sides = table["side"].to_numpy()
    parts = [table["rows"].combine_chunks().slice(int(i), 1).flatten() for i in np.argsort(sides)]
    held = pa.concat_arrays(parts)
    node, size = (held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "n"))
    same = len(parts) == 1
    x = unit(_vectors(held.field("embedding")))
    left = np.arange(len(parts[0]))
    right = left if same else np.arange(len(parts[0]), len(held))
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    for i, j in tile_links(x[left], x[right], same):
        i, j = left[i], right[j]
        np.add.at(links, i, size[j])
        np.add.at(links, j, size[i])
        while (label[i] != label[j]).any():  # each round hangs the larger of two roots below the smaller
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    k, e = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(node)))
    return pa.table(
        {
            "a": pa.array(np.concatenate([node[k], node[e]]), pa.int64()),
            "b": pa.array(np.concatenate([node[k], node[label[e]]]), pa.int64()),
            "links": pa.array(np.concatenate([links[k], np.zeros(len(e), np.int64)]), pa.int64()),
        }
    )


def _numbered(batches):
    """Adds the place of each row among those of its dimension in a sorted partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for b in batches:
        pos = np.empty(len(b), np.int64)
        for k, d in enumerate(b.column("dim").to_numpy()):
            pos[k] = seen[d] = seen.get(d, -1) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int64)), pa.array(pos)], [*b.schema.names, "part", "pos"])


def _project(batches):
    """Adds the first projection."""
    for b in batches:
        lists, dims = b.column("embedding"), b.column("dim").to_numpy()
        values, at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(dims)])
        p = np.empty(len(dims))
        for d in np.unique(dims):
            own = np.flatnonzero(dims == d)
            p[own] = unit(values[at[own][:, None] + np.arange(d)]) @ directions(int(d))[:, 0]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, "p"])


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    ok = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").selectExpr("vec_id", f"CASE WHEN {ok} THEN embedding END AS embedding")
    classes = stash(own.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).withColumn("dim", F.size("embedding")))
    kind = classes.schema["embedding"].dataType.simpleString()
    base = f"embedding {kind}, node bigint, n bigint, dim int, p double"
    ordered = stash(classes.mapInArrow(_project, base).repartitionByRange("dim", "p").sortWithinPartitions("dim", "p").mapInArrow(_numbered, base + ", part bigint, pos bigint"))
    parts = ordered.groupBy("dim", "part").agg(F.count("*").alias("k"))
    before = parts.withColumn("before", F.sum("k").over(Window.partitionBy("dim").orderBy("part")) - F.col("k")).drop("k")  # a row for each partition
    ranked = ordered.join(before, ["dim", "part"]).withColumn("tile", F.expr(f"(before + pos) div least({TILE}, greatest(1, {NUMBERS} div dim))"))
    tiles = stash(ranked.groupBy("dim", "tile").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.collect_list(F.struct("node", "n", "embedding")).alias("rows")))  # TILE at most
    reach = REACH * math.sqrt(2 - 2 * cosine)
    span = tiles.select("dim", "tile", "low", "high")
    band = f"explode(sequence(CAST(floor(low / {reach}) AS INT), CAST(floor(high / {reach}) AS INT) + {{more}})) AS band"
    a, b = span.selectExpr("dim", "tile AS s", "high AS top", band.format(more=1)), span.selectExpr("dim", "tile AS t", "low AS bottom", band.format(more=0))
    # Tiles ascend with the first projection, so the earlier one's top and the later one's bottom decide.
    pairs = stash(a.join(b, ["dim", "band"]).where(f"s <= t AND bottom - top <= {reach}").select("dim", "s", "t").distinct())
    both = "CASE WHEN s = t THEN array(named_struct('tile', s, 'side', 0)) ELSE array(named_struct('tile', s, 'side', 0), named_struct('tile', t, 'side', 1)) END"
    sides = pairs.selectExpr("dim", "s", "t", f"inline({both})")
    met = tiles.select("dim", "tile", "rows").join(sides, ["dim", "tile"]).select("dim", "s", "t", "side", "rows").groupBy("dim", "s", "t").applyInArrow(_meet, "a bigint, b bigint, links bigint")
    found = stash(met)
    summed = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("links = 0").select("a", "b"))
    judged = classes.join(summed, "node", "left").join(roots, "node", "left").select("embedding", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    lone = own.where("embedding IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    all_rows = own.where("embedding IS NOT NULL").join(judged, "embedding").select("vec_id", "n_links", "component_id").union(lone)
    return all_rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))

"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

1. From every run of MATCH bytes one suffix is sampled (suffixes.py), read to the right or, reversed, to the left: either way it
   is cut where a run around it may end. A batch of documents gets a suffix array: its distinct suffixes, sorted over all
   partitions by the names of their prefixes of three lengths (64-bit numbers of equal strings, as in prefix doubling), each with
   how often it occurs and the smallest and largest content around it. A new array is merge-scanned against every level: of two
   neighbours in the merged order the common prefix is read off the names, and one as long as the suffixes is a match. Arrays of
   equal size merge in the same scan, so a suffix is rewritten a number of times logarithmic in the number of batches.
2. A segment (up to 369 runs of MATCH bytes around one sampled suffix) that matches with the whole of its content is repeated
   throughout. Of the other matching segments one of each content is cut into chunks of a few runs, by the same rule those into
   runs, and runs found twice are repeated.
3. Bytes that repeated runs cover are removed; texts are read again only where a part of them goes.

Names only nominate. What counts as equal in steps 2 and 3 is a 128-bit hash (XXH3) of the bytes themselves, so no structure of a
text (as in Thue-Morse words) makes different strings equal. A suffix that very many documents share is one row from the first
partial sum on; nothing is collected. A document's segments and spans meet in one row, as its text does.

Defined results: null text is empty; texts below MATCH bytes are kept whole; repeated rows (same doc_id, same text or not) are
documents of their own, so their long texts go; of ties none stays: every copy of a repeated string goes; very long texts are worked
on in blocks; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, shared_dir
from .suffixes import GRAM, MATCH, PREFIXES, SIDE, Block, blocks, segments

BATCHES = 4
#: Runs that are looked at together before they are looked at one by one.
CHUNK = 16
EMPTY = hashlib.sha256(b"").hexdigest()
#: First run, how many, where the sampled suffix starts; the content; names of the prefixes: the gram, then by side a longer one and the whole.
SEGMENT = "struct<low:int,n:int,at:int,o:bigint,p:bigint,a:bigint,bl:bigint,kl:bigint,br:bigint,kr:bigint>"
#: A suffix by its names, the smallest and the largest content around it (half their hashes), how often it occurs, and whether it came
#: from two arrays in the last scan.
COLUMNS = ["a", "b", "key", "least", "most", "n", "met"]
ENTRY = ", ".join(f"{c} bigint" for c in COLUMNS)


def _utf8(x: pa.Scalar) -> bytes:
    return (x.as_py() or "").encode("utf-8", "surrogatepass")


def _digests(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a 128-bit hash of each string."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<i8").reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def _sampled(text: bytes) -> list[np.ndarray]:
    """Columns of SEGMENT over a whole text; a name is 0 on a side without runs."""
    out = []
    for a, b in blocks(len(text)):
        data = np.frombuffer(text, np.uint8, b - a, a)
        block = Block(data)
        s = segments(data, block)
        left, right = s.low <= s.at - SIDE, s.low + s.n - 1 > s.at - SIDE
        names = [block.hashes(s.at, GRAM, 1)]
        for size in PREFIXES:  # to the left: from `size` bytes before the gram to its end
            names.append(np.where(left, block.hashes(np.where(left, s.at - size, 0), size + GRAM, 2), 0))
        for size in PREFIXES:
            names.append(np.where(right, block.hashes(np.where(right, s.at, 0), GRAM + size + 1, 3), 0))
        content = _digests(text[i:j] for i, j in zip((s.low + a).tolist(), (s.low + s.n + (MATCH - 1 + a)).tolist()))
        out.append((s.low + a, s.n, s.at + a, *content, *names))
    return [np.concatenate(x) for x in zip(*out)] or [np.empty(0, np.int64)] * 10


def described(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """rid (unique), batch, doc_id, t (hash of the text), n_bytes, sha256, segs of every row."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        batch = TaskContext.get().partitionId() % batches
        for b in it:
            for at in range(0, len(b), 500):
                part = b.slice(at, 500)
                texts = [_utf8(x) for x in part.column(2)]
                columns = [_sampled(x) for x in texts]
                offsets = pa.array(np.cumsum([0, *(len(c[0]) for c in columns)]), pa.int32())
                kinds = [pa.int32()] * 3 + [pa.int64()] * 7
                flat = [pa.array(np.concatenate(x), k) for x, k in zip(zip(*columns), kinds)]
                segs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["low", "n", "at", "o", "p", "a", "bl", "kl", "br", "kr"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + len(part))), pa.array(np.full(len(part), batch, np.int32)), part.column(0), part.column(1), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), segs],
                    ["rid", "batch", "doc_id", "t", "n_bytes", "sha256", "segs"],
                )
                rid += len(part)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(rows, f"rid bigint, batch int, doc_id {kind}, t bigint, n_bytes bigint, sha256 string, segs array<{SEGMENT}>")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are written out and no longer referred to: it does so when the driver collects
    garbage, which it seldom needs to by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _scanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge-scan of sorted ENTRY rows: neighbours whose common prefix is the whole suffix become one, with their counts and contents."""
    held = np.empty((len(COLUMNS), 0), np.int64)  # the last suffix, which the next rows may go on with
    for b in it:
        if len(b):
            merged = _united_entries(np.hstack([held, np.stack([x.to_numpy() for x in b.columns])]))
            held = merged[:, -1:]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged[:, :-1])), COLUMNS)
    yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), COLUMNS)


def _united_entries(rows: np.ndarray) -> np.ndarray:
    """COLUMNS of sorted rows, one for each suffix: extremes of the contents, sums of n."""
    lcp = np.cumprod(rows[:3, 1:] == rows[:3, :-1], axis=0).sum(0)  # prefixes that neighbours share, of three
    first = np.flatnonzero(np.concatenate([[True], lcp < 3]))
    met = np.maximum.reduceat(rows[6], first) | (np.diff(np.append(first, rows.shape[1])) > 1)
    return np.vstack([rows[:3, first], np.minimum.reduceat(rows[3], first), np.maximum.reduceat(rows[4], first), np.add.reduceat(rows[5], first), met])


class Tables:
    """Named tables in a folder of their own within the shared one; those that are done with are deleted before the next are written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark)}/suffix-dedup-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        df.write.partitionBy(*by).parquet(f"{self.folder}/{name}") if by else df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables, and lets Spark delete the shuffle files of what was written before."""
        dropped(self.spark, *(f"{self.folder}/{n}" for n in names))
        release(self.spark)


class IndexFamily:
    """Levels of sorted suffix arrays; sizes are counted in batches."""

    def __init__(self, tables: Tables) -> None:
        self.tables, self.made = tables, 0
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.matches: dict[str, DataFrame] = {}

    def _scan(self, *arrays: DataFrame) -> DataFrame:
        """The arrays in one order, equal suffixes united. Rows are distinct in each array, so ranges are even however common a suffix is."""
        rows = arrays[0]
        for other in arrays[1:]:
            rows = rows.union(other)
        return rows.withColumn("met", F.lit(0).cast("long")).repartitionByRange("a", "b", "key").sortWithinPartitions("a", "b", "key").mapInArrow(_scanned, ENTRY)

    def _level(self, size: int, array: DataFrame) -> tuple[int, str, DataFrame]:
        self.made += 1
        return size, f"level-{self.made}", self.tables.put(f"level-{self.made}", array)

    def _note(self, array: DataFrame, which: str) -> None:
        name = f"matches-{len(self.matches)}"
        self.matches[name] = self.tables.put(name, array.where(which).select("key", "least", "most"))

    def add(self, suffixes: DataFrame) -> None:
        """Gives a batch (a, b, key, o) its suffix array, notes matches within it and with every level, and merges equal levels."""
        distinct = suffixes.groupBy("a", "b", "key").agg(F.min("o").alias("least"), F.max("o").alias("most"), F.count("*").alias("n"))
        new = self._level(1, self._scan(distinct))
        self._note(new[2], "n > 1")
        merging = 0  # as many of the last levels as the new one carries into
        while merging < len(self.levels) and self.levels[-1 - merging][0] == 1 << merging:
            merging += 1
        for _, _, other in self.levels[: len(self.levels) - merging]:
            self._note(self._scan(new[2], other), "met = 1")
        for _ in range(merging):
            size, name, other = self.levels.pop()
            merged = self._level(2 * size, self._scan(new[2], other))
            self._note(merged[2], "met = 1")
            self.tables.drop(new[1], name)
            new = merged
        self.levels.append(new)
        if not merging:
            release(self.tables.spark)

    def repeated(self) -> DataFrame:
        """key, mixed (whether different contents share it) of the suffixes that occur twice or more in all batches together."""
        found = None
        for m in self.matches.values():
            found = m if found is None else found.union(m)
        return found.groupBy("key").agg((F.min("least") != F.max("most")).alias("mixed"))

    def close(self) -> None:
        self.tables.drop(*(name for _, name, _ in self.levels), *self.matches)


def _chunks(texts: DataFrame) -> DataFrame:
    """Chunks of the wanted segments of texts: up to CHUNK runs whose distance to the sampled suffix has the same quotient by CHUNK.

    o, p, rel, n: the segment's content, the first run's place in it, and how many; core: the bytes that all runs of a whole such
    chunk share; outer, outer2: all bytes of the runs; hs: a 64-bit hash of each run. Equal runs have equal cores, so core and hash tell
    runs apart."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple[np.ndarray, ...]] = []
            for text, wanted in zip(b.column(0), b.column(1)):
                raw = _utf8(text)
                data = np.frombuffer(raw, np.uint8)
                for w in wanted.as_py():
                    low, n, at = w["low"], w["n"], w["at"]
                    cut = min(n, max(0, at - SIDE + 1 - low))
                    a, z = (0 if w["l"] else cut), (n if w["r"] else cut)
                    if a < z:
                        block = Block(data[low + a : low + z + MATCH - 1])
                        which = (at - low - np.arange(a, z)) // CHUNK
                        first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
                        size = np.diff(np.append(first, z - a))
                        core = block.hashes(at - low - a - which[first] * CHUNK, MATCH - CHUNK + 1, 5)
                        outer = _digests(raw[i : i + k + MATCH - 1] for i, k in zip((first + low + a).tolist(), size.tolist()))
                        runs = np.array([xxhash.xxh3_64_intdigest(raw[i : i + MATCH]) for i in range(low + a, low + z)], np.uint64).view(np.int64)
                        out.append((np.full(len(first), w["o"]), np.full(len(first), w["p"]), first + a, size, core, *outer, runs))
            if out:
                o, p, rel, size, core, outer, outer2, h = (np.concatenate(x) for x in zip(*out))
                hs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(h))
                yield pa.RecordBatch.from_arrays([pa.array(o), pa.array(p), pa.array(rel, pa.int32()), pa.array(size, pa.int32()), pa.array(core), pa.array(outer), pa.array(outer2), hs], ["o", "p", "rel", "n", "core", "outer", "outer2", "hs"])

    return texts.select("text", "wanted").mapInArrow(batches, "o bigint, p bigint, rel int, n int, core bigint, outer bigint, outer2 bigint, hs array<bigint>")


def repeated(rows: DataFrame, spot: Column, *columns: str) -> DataFrame:
    """Values of columns that occur at two spots (64-bit hashes) or more."""
    return rows.groupBy(*columns).agg(F.min(spot).alias("_p"), F.max(spot).alias("_q")).where("_p <> _q").select(*columns)


def _united(starts: DataFrame) -> DataFrame:
    """Per rid, the maximal stretches that the stretches (a, z) cover: spans, n_removed."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans, total = [], []
            for x in b.column(1):
                ends: list[list[int]] = []
                for s in sorted((s["a"], s["z"]) for s in x.as_py()):
                    if ends and s[0] <= ends[-1][1]:
                        ends[-1][1] = max(ends[-1][1], s[1])
                    else:
                        ends.append([*s])
                spans.append(ends)
                total.append(sum(z - a for a, z in ends))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(total, pa.int64())], ["rid", "spans", "n_removed"])

    grouped = starts.groupBy("rid").agg(F.collect_list(F.struct("a", "z")).alias("s"))  # at most one for each byte of a text
    return grouped.mapInArrow(batches, "rid bigint, spans array<array<bigint>>, n_removed bigint")


def removed(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed stretches) of every row of docs."""
    tables = Tables(docs.sparkSession)
    put = tables.put
    raw = put("raw", described(docs, batches), "batch")
    # A sampled suffix's place in one number: start of its segment, runs in it, distance of the suffix, side.
    packed = "shiftleft(CAST(s.low AS BIGINT), 20) | shiftleft(CAST(s.n AS BIGINT), 10) | shiftleft(CAST(s.at - s.low AS BIGINT), 1)"
    sides = "array(named_struct('loc', loc, 'b', s.bl, 'key', s.kl), named_struct('loc', loc + 1, 'b', s.br, 'key', s.kr))"
    segs = raw.selectExpr("batch", "rid", "explode(segs) AS s")
    sampled = segs.selectExpr("batch", "rid", "s", f"{packed} AS loc").selectExpr("batch", "rid", "s.o", "s.p", "s.a", f"explode({sides}) AS x").selectExpr("batch", "rid", "o", "p", "a", "x.*").where("key <> 0")
    unpacked = ["rid", "o", "p", "mixed", "loc & 1 AS side", "CAST(shiftright(loc, 20) AS INT) AS low", "CAST(shiftright(loc, 10) & 1023 AS INT) AS n", "CAST(shiftright(loc, 20) + (shiftright(loc, 1) & 511) AS INT) AS at"]
    family = IndexFamily(tables)
    for i in range(batches):
        family.add(sampled.where(F.col("batch") == i).select("a", "b", "key", "o"))
    keys = put("keys", family.repeated())
    family.close()
    c = put("c", sampled.select("rid", "o", "p", "loc", "key").join(keys, "key").selectExpr(*unpacked))
    d = put("d", raw.select("rid", "doc_id", "t", "n_bytes", "sha256"))
    tables.drop("raw", "keys")
    content = ["o", "p"]
    whole = put("whole", repeated(c, F.xxhash64("rid", "low"), *content))
    reps = c.where("mixed").groupBy(*content).agg(F.min(F.struct("rid", "low", "n", "at")).alias("x"), F.max(F.col("side") == 0).alias("l"), F.max(F.col("side") == 1).alias("r")).select(*content, "x.*", "l", "r")
    wanted = put("wanted", reps.groupBy("rid").agg(F.collect_list(F.struct("o", "p", "low", "n", "at", "l", "r")).alias("wanted")))
    ids = d.select("rid", F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    some = c.select("rid").distinct().join(ids, "rid")
    own = docs.select("doc_id", F.xxhash64("text").alias("t"), F.col("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))
    texts = put("texts", own.join(some.select("_id", "_t").distinct(), same, "left_semi"))
    release(docs.sparkSession)
    chunks = put("chunks", _chunks(texts.join(wanted.join(ids, "rid"), same).select("text", "wanted")))
    spot = F.xxhash64("o", "p", "rel")
    full = put("full", chunks.join(repeated(chunks, spot, "outer", "outer2"), ["outer", "outer2"], "left_semi").select("o", "p", "rel", "n"))
    open_ = chunks.join(repeated(chunks, F.xxhash64("outer", "outer2"), "core"), "core", "left_semi")
    runs = put("runs", open_.select("o", "p", "core", F.posexplode("hs").alias("i", "h"), "rel").select("o", "p", "core", (F.col("rel") + F.col("i")).alias("rel"), "h"))
    tables.drop("chunks")
    single = runs.join(repeated(runs, spot, "core", "h"), ["core", "h"], "left_semi").select("o", "p", "rel", F.lit(1).alias("n"))
    parts = put("parts", full.unionByName(single).groupBy(*content).agg(F.collect_list(F.struct("rel", "n")).alias("parts")))  # at most MATCH of them
    # A content's repeated stretches, null for all of it; one join, so that a content that very many places have is split over tasks.
    partly = parts.join(whole, content, "left_anti").select(*content, "parts")
    marks = put("marks", partly.unionByName(whole.withColumn("parts", F.lit(None).cast(parts.schema["parts"].dataType))))
    tables.drop("full", "runs", "parts", "whole")
    places = put("places", c.select("rid", "low", "n", *content).distinct())
    stretches = F.explode(F.coalesce("parts", F.array(F.struct(F.lit(0).alias("rel"), "n"))))
    covered = places.join(marks, content).select("rid", "low", stretches.alias("x")).select("rid", (F.col("low") + F.col("x.rel")).cast("long").alias("a"), (F.col("low") + F.col("x.rel") + F.col("x.n") + (MATCH - 1)).cast("long").alias("z"))
    spans = put("spans", _united(covered))
    judged = put("judged", d.join(spans, "rid", "left"))
    tables.drop("c", "places", "marks", "wanted", "spans")
    cut = judged.where("n_removed < n_bytes")
    rest = cut.select("rid", F.col("doc_id").alias("_id"), F.col("t").alias("_t"), "spans").join(texts, same).select("rid", "text", "spans")

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            digests = []
            for text, spans in zip(b.column(1), b.column(2)):
                data, at, digest = _utf8(text), 0, hashlib.sha256()
                for a, z in spans.as_py():
                    digest.update(data[at:a])
                    at = z
                digest.update(data[at:])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests)], ["rid", "rest"])

    out = judged.join(rest.mapInArrow(kept, "rid bigint, rest string").dropDuplicates(["rid"]), "rid", "left")  # repeated rows find each other's text
    digest = F.when(F.col("n_removed").isNull(), F.col("sha256")).when(F.col("n_removed") == F.col("n_bytes"), EMPTY).otherwise(F.col("rest"))
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"), digest.alias("kept_sha256"), "spans")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")

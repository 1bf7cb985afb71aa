"""Hard negatives by distributed radix selection.

Every anchor wants its best rows of its own label (positives), then, for each positive, the best rows of other labels whose score lies in
a window set by the positive's. Scores are integer inner products, so the best k of a window are found digit by digit without sorting or
keeping scores: one pass over the vectors gives each task's histogram of the leading digit of each window, summed by window and digit;
the bucket that holds the kth row is refined by the next digit, until few rows lie at or above it. Where ties keep it crowded, the digits
of vec_id follow, as ties go by the smaller one. Then one pass gathers only the rows that qualify, and these are ranked.

The anchors are a stated query set, held against all rows in blocks: SLAB of them at a time are sent to the tasks (bounded in rows and
numbers), which multiply them with the vectors where those lie. No vector is shuffled; what is, are histograms of at most 2^DIGIT numbers
a window, and rows that qualify. A window costs its task 2^DIGIT numbers, whatever the number of vectors. Work grows with anchors times
rows, which the task sets.

Defined results: rows with a null vec_id, label or vector, with a null or non-finite component, or so long that scores may not fit a long
(2^31 after scaling) take no part; vectors of different dimensions do not meet; an anchor is never its own positive, nor is another row of its vec_id; rows that repeat
a vec_id are rows of their own, also as anchors; fewer rows than wanted: all; windows of a negative score are empty, that of zero holds
zero; ties go by vec_id; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stash

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of its positive's.
LOW, HIGH = 30, 90
#: Anchors that are sent to the tasks at a time, and their numbers, at most.
SLAB, NUMBERS = 2048, 1 << 23
#: Bits of a digit.
DIGIT = 9
#: A bucket is not refined further once so many times the wanted rows qualify.
ENOUGH = 8
#: Scores that a task holds at once.
SCORES = 1 << 21
#: Norm of a vector of integers up to which scores fit a long.
LONGEST = float(1 << 31)


@dataclass
class Anchors:
    """A slab: ids, labels, and integer vectors by dimension (which anchors, their vectors). longest: the greatest norm."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]
    longest: float


@dataclass
class Windows:
    """What is known of the windows of a slab's anchors. An offset is how far a score lies below the window's high end. Rows with offset
    below `start`, or in [start, start + size) and, where `ties` says so, with an id offset below id_start + id_size are still open."""

    anchor: np.ndarray
    high: np.ndarray
    span: np.ndarray
    k: int
    same: bool

    def __post_init__(self) -> None:
        n = len(self.anchor)
        self.need, self.start, self.shift = np.full(n, self.k, np.int64), np.zeros(n, np.int64), np.maximum(0, _bits(self.span) - DIGIT)
        self.size = self.span.copy()
        self.ties, self.done = np.zeros(n, bool), self.span <= 0
        self.id_start, self.id_size, self.id_shift = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)

    def narrow(self, found: pa.Table, ids: int) -> None:
        """Takes for each open window the bucket with its kth row (w, bucket, before, n); ids: the range of vec_ids."""
        hit = np.zeros(len(self.anchor), bool)
        for w, bucket, before, n in zip(*(found[c].to_pylist() for c in ("w", "bucket", "before", "n"))):
            hit[w] = True
            self.need[w] -= before
            if self.ties[w]:
                self.id_start[w] += np.uint64(bucket) << np.uint64(self.id_shift[w])
                self.id_size[w] = np.uint64(1) << np.uint64(self.id_shift[w])
            else:
                self.start[w] += bucket << int(self.shift[w])
                self.size[w] = 1 << int(self.shift[w])
            if self.k - self.need[w] + n <= ENOUGH * self.k or self.ties[w] and self.id_shift[w] == 0:
                self.done[w] = True
            elif self.ties[w]:
                self.id_shift[w] = max(0, self.id_shift[w] - DIGIT)
            elif self.shift[w] > 0:
                self.shift[w] = max(0, self.shift[w] - DIGIT)
            else:
                self.ties[w], self.id_size[w], self.id_shift[w] = True, np.uint64(min(ids, (1 << 64) - 1)), max(0, (ids - 1).bit_length() - DIGIT)
        self.done |= ~hit  # fewer rows than wanted in the whole window: all qualify


def _bits(n: np.ndarray) -> np.ndarray:
    return np.array([int(x - 1).bit_length() if x > 0 else 0 for x in n.tolist()], np.int64)


def prepared(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, q (the components times scale, rounded down), norm of the rows that take part, dealt out evenly."""
    whole = vectors.schema["label"].dataType.typeName() in ("byte", "short", "integer", "long")
    ok = "vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    own = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long" if whole else "string").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stash(own.withColumn("norm", norm).where(F.col("norm") < LONGEST).repartition(parts))


def slabs(rows: DataFrame, is_anchor: Column) -> Iterator[Anchors]:
    """The anchors, at most SLAB of them (and, but for one alone, NUMBERS numbers) at a time."""
    spark = rows.sparkSession
    own = rows.where(is_anchor)
    total = own.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dim")).first()
    each = max(1, min(SLAB, NUMBERS // max(1, total["dim"])))
    path = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"
    own.repartition(max(1, -(-total["n"] // each))).write.option("maxRecordsPerFile", each).parquet(path)
    for file in sorted(spark.read.schema(own.schema).parquet(path).inputFiles()):
        t = spark.read.schema(own.schema).parquet(file).toArrow()  # at most `each` rows
        if t.num_rows:
            dims = np.array([len(x) for x in t["q"].to_pylist()])
            held = {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}
            yield Anchors(t["vec_id"].to_numpy(), np.array(t["label"].to_pylist()), {d: (at, _matrix(t["q"].combine_chunks().take(pa.array(at)), d)) for d, at in held.items()}, max(t["norm"].to_pylist()))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), dim)


def blocks(batches: Iterator[pa.RecordBatch], a: Anchors, active: np.ndarray, longest: float):
    """Yields (anchors, vec_ids, labels, scores) of blocks of rows (vec_id, label, q) with the active anchors of their dimension. Floats
    multiply faster; all products and sums are integers below the bound, so they are exact in the type that is chosen by it."""
    bound = a.longest * longest
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
    held = {d: (at[own := active[at]], q[own].astype(kind)) for d, (at, q) in a.vectors.items()}
    for b in batches:
        dims = np.diff(b.column(2).offsets.to_numpy())
        for d in np.unique(dims).tolist():
            at, q = held.get(d, (np.zeros(0, int), None))
            if not len(at):
                continue
            own = np.flatnonzero(dims == d)
            step = max(1, SCORES // len(at))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                x = _matrix(b.column(2).take(pa.array(part)), d).astype(kind)
                labels = b.column(1).take(pa.array(part)).to_numpy(zero_copy_only=False)
                yield at, b.column(0).take(pa.array(part)).to_numpy(), labels, (q @ x.T).astype(np.int64)


def open_rows(batches: Iterator[pa.RecordBatch], a: Anchors, w: Windows, which: np.ndarray, longest: float):
    """Yields (window, offsets, vec_ids) of the rows in each window of `which`, block by block; of the right label, never the anchor."""
    of = [np.zeros(0, int)] * len(a.ids)
    for i in np.unique(w.anchor[which]):
        of[i] = which[w.anchor[which] == i]
    active = np.array([len(x) > 0 for x in of])
    for at, ids, labels, scores in blocks(batches, a, active, longest):
        rows: dict = {}
        for i, s in zip(at.tolist(), scores):
            label = a.labels[i]
            if label not in rows:
                rows[label] = np.flatnonzero((labels == label) == w.same)
            own = rows[label]
            own_scores, own_ids = s[own], ids[own]
            if w.same:
                other = own_ids != a.ids[i]
                own_scores, own_ids = own_scores[other], own_ids[other]
            for k in of[i].tolist():
                offset = w.high[k] - own_scores
                inside = offset.view(np.uint64) < np.uint64(w.span[k])  # a negative offset is a large number
                yield k, offset[inside], own_ids[inside]


def selected(rows: DataFrame, a: Anchors, w: Windows, limits: dict) -> Callable[[str, Callable[[int], tuple]], DataFrame]:
    """Narrows the windows until few rows beyond the wanted ones qualify; gives a function that gathers those rows."""
    spark = rows.sparkSession
    first, ids, longest = limits["first"], limits["last"] - limits["first"] + 1, limits["longest"]

    while not w.done.all():
        share = spark.sparkContext.broadcast((a, w, np.flatnonzero(~w.done)))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, w, which = share.value
            place = np.zeros(len(w.anchor), int)
            place[which] = np.arange(len(which))
            sums = np.zeros((len(which), 1 << DIGIT), np.int64)
            for k, offset, vec in open_rows(batches, a, w, which, longest):
                if w.ties[k]:
                    vec = (vec[offset == w.start[k]] - first).view(np.uint64) - w.id_start[k]  # below id_start: a large number
                    bucket = vec[vec < w.id_size[k]] >> np.uint64(w.id_shift[k])
                else:
                    rest = offset - w.start[k]
                    bucket = rest[rest.view(np.uint64) < np.uint64(w.size[k])] >> w.shift[k]
                if len(bucket):
                    sums[place[k]] += np.bincount(bucket.astype(np.int64), minlength=1 << DIGIT)
            k, bucket = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(which[k], pa.int64()), pa.array(w.need[which[k]]), pa.array(bucket, pa.int64()), pa.array(sums[k, bucket])], ["w", "need", "bucket", "n"])

        counts = rows.select("vec_id", "label", "q").mapInArrow(count, "w bigint, need bigint, bucket bigint, n bigint").groupBy("w", "need", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("bucket"))
        found = counts.withColumn("upto", upto).where("upto >= need AND upto - n < need").selectExpr("w", "bucket", "upto - n AS before", "n").toArrow()  # a row a window
        w.narrow(found, ids)

    share = spark.sparkContext.broadcast((a, w, np.flatnonzero(w.span > 0)))

    def gather(kind: str, notes: Callable[[int], tuple]) -> DataFrame:
        names = [x.split()[0] for x in kind.split(", ")]

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, w, which = share.value
            for k, offset, vec in open_rows(batches, a, w, which, longest):
                good = offset < w.start[k] + w.size[k]
                if w.ties[k]:
                    good &= (offset < w.start[k]) | ((vec - first).view(np.uint64) < w.id_start[k] + w.id_size[k])
                if good.any():
                    both, n = np.unique(np.stack([w.high[k] - offset[good], vec[good]]), axis=1, return_counts=True)
                    told = [pa.array([x] * len(n), pa.int64()) for x in (k, *notes(k))]
                    yield pa.RecordBatch.from_arrays([*told, pa.array(both[0]), pa.array(both[1]), pa.array(n.astype(np.int64))], names)

        return rows.select("vec_id", "label", "q").mapInArrow(rows_of, kind)

    return gather


def ranked(gathered: DataFrame, k: int) -> DataFrame:
    """The first k rows of each window, with rank from 1. Rows of one score and vec_id come with their number n."""
    keys = [c for c in gathered.columns if c != "n"]
    order = Window.partitionBy("w").orderBy(F.desc("score"), "vec_id")
    sums = gathered.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(order) - F.col("n")).where(F.col("before") < k)
    return sums.select(*keys, F.explode(F.transform(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(k))), lambda x: x.cast("int"))).alias("rank"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from rows (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    rows = prepared(vectors, scale)
    limits = rows.agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last"), F.max("norm").alias("longest")).first().asDict()
    path, columns = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}", "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    for a in slabs(rows, is_anchor):
        top = int(a.longest * limits["longest"]) + 1
        n = len(a.ids)
        own = Windows(np.arange(n), np.full(n, top), np.full(n, 2 * top + 1), positives, True)
        found = ranked(selected(rows, a, own, limits)("w bigint, score bigint, vec_id bigint, n bigint", lambda k: ()), positives).orderBy("w", "rank").toArrow()  # at most `positives` an anchor
        anchor, positive, score = (found[c].to_numpy() for c in ("w", "vec_id", "score"))
        if not len(anchor):
            continue
        least, most = (np.array([f(int(s)) for s in score], np.int64) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
        near = Windows(anchor, most, most - least + 1, negatives, False)
        notes = {"anchor": a.ids[anchor], "positive": positive, "score": score}
        gathered = selected(rows, a, near, limits)("w bigint, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, vec_id bigint, n bigint", lambda k, t=notes: (int(t["anchor"][k]), int(t["positive"][k]), int(t["score"][k])))
        ranked(gathered, negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    spark.createDataFrame([], columns).write.mode("append").parquet(path)
    return spark.read.schema(columns).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 100 == 0)


OP11_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
 p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

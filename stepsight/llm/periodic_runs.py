"""Periodic runs of words: stretches that repeat with a period, three times or more.

A run of period q and length max(LEAST, TIMES * q) or more equals itself shifted by q over at least overlap() words, so each of its words
lies in a k-gram, k = overlap(), that the document has again. Words in no repeated k-gram are masked out; hashes of k-grams only
nominate, a collision leaves more words than needed. What survives are few short segments, and only they are searched.

Segments go through Main-Lorentz: a segment is halved again and again, and a run is found where it crosses the middle m of the smallest
block that holds it: for each period p, the words from m and from m + p (or m - p) on agree for so long to either side. All blocks of one
depth of many documents are done at once. How far two places agree is told by numbers of all stretches of 1, 2, 4, ... words, equal just
for equal stretches, so results are exact. Of equal stretches the smallest period counts.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; null or empty text, or one without a word: no run, and an empty collapsed text; texts are
read whole and one by one, a long one takes memory in proportion to its surviving words and the logarithm of the longest segment (about
a hundred bytes a word); rows that repeat a doc_id, or have none, are judged each; an empty table gives no rows; further columns are
ignored, whatever their names. No rows are moved between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words

#: Words of a run at least, and its periods.
LEAST, TIMES = 24, 3
#: Words that are searched at once, about.
WORDS = 400_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """Words that every run has in common with itself, shifted by its period, at least."""
    return min(max(least, times * q) - q for q in range(1, least // times + 2))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b * _B
    x ^= x >> np.uint64(32)
    x *= _C
    return x ^ (x >> np.uint64(29))


def repeated(hashes: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that their document has again. hashes, docs: of each word; a document's words stand together."""
    if len(hashes) < k:
        return np.zeros(len(hashes), bool)
    gram, size = _mixed(hashes.view(np.uint64), docs.astype(np.uint64)), 1
    while 2 * size <= k:
        gram, size = _mixed(gram[: len(gram) - size], gram[size:]), 2 * size
    gram = _mixed(gram[: len(hashes) - k + 1], gram[k - size :][: len(hashes) - k + 1])
    at = np.flatnonzero(docs[: len(docs) - k + 1] == docs[k - 1 :])
    order = at[np.argsort(gram[at])]
    same = gram[order[1:]] == gram[order[:-1]]
    change = np.zeros(len(hashes) + 1, np.int32)
    for part in (order[1:][same], order[:-1][same]):
        starts = np.unique(part)
        change[starts] += 1
        change[starts + k] -= 1
    return np.cumsum(change[:-1]) > 0


class Stretches:
    """Numbers of all stretches of 1, 2, 4, ... words: equal numbers, equal stretches."""

    def __init__(self, ids: np.ndarray, longest: int) -> None:
        self.levels = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
        while 2 << len(self.levels) - 1 <= longest:
            last, size = self.levels[-1].astype(np.int64), 1 << len(self.levels) - 1
            pairs = last[: len(last) - size] * (last.max() + 1) + last[size:]
            self.levels.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))

    def same(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the stretches that begin at x and y are equal; not where one lies beyond either end. x < y."""
        names = self.levels[level]
        inside = (x >= 0) & (y < len(names))
        return inside & (names[np.where(inside, x, 0)] == names[np.where(inside, y, 0)])

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words from x and y on that agree."""
        n = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            n += self.same(level, x + n, y + n).astype(np.int64) << level
        return n

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words before x and y that agree."""
        n = np.zeros(len(x), np.int64)
        for level in reversed(range(len(self.levels))):
            back = n + (1 << level)
            n += self.same(level, x - back, y - back).astype(np.int64) << level
        return n


def main_lorentz(ids: np.ndarray, low: np.ndarray, high: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of all runs in the segments [low, high) of ids, by start and period. Between segments stands a number
    that occurs nowhere else, so no agreement goes beyond a segment."""
    keep = high - low >= least
    low, high = low[keep], high[keep]
    if not len(low):
        return np.zeros((0, 3), np.int64)
    names, half = Stretches(ids, int((high - low).max())), -(-overlap(least, times) // 2)
    level = half.bit_length() - 1  # a run's overlap has half of its words to one side of the middle
    found = []
    while len(low):
        middle, n = (low + high) // 2, (high - low) // times
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        m = np.repeat(middle, n)
        for x, y in ((m, m + p), (m - p, m)):
            some = names.same(level, x, y) | names.same(level, x - (1 << level), y - (1 << level))
            x, y, period = x[some], y[some], p[some]
            start, end = x - names.behind(x, y), y + names.ahead(x, y)
            good = end - start >= np.maximum(least, times * period)
            found.append(np.stack([start[good], end[good], period[good]], axis=1))
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        keep = high - low >= least
        low, high = low[keep], high[keep]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(w) for w in texts])
    if not sizes.sum():
        return out
    docs = np.repeat(np.arange(len(texts)), sizes)
    hashes = np.fromiter((hash(w) for own in texts for w in own), np.int64, len(docs))
    held = np.concatenate([[0], (repeated(hashes, docs, overlap(least, times)) * (docs + 1)), [0]])
    cut = np.flatnonzero(held[1:] != held[:-1])  # a segment begins or ends, or a document does within a stretch of survivors
    low, high = cut[:-1], cut[1:]
    real = held[low + 1] > 0 if len(low) else np.zeros(0, bool)
    low, high = low[real], high[real]
    keep = high - low >= least
    low, high = low[keep], high[keep]
    if not len(low):
        return out
    before = np.cumsum(sizes) - sizes
    own, first = docs[low], low - before[docs[low]]
    numbers: dict[bytes, int] = {}
    ids, starts, at = [], [], 0
    for k, (d, a, n) in enumerate(zip(own.tolist(), first.tolist(), (high - low).tolist())):
        starts.append(at)
        ids.append([numbers.setdefault(w, len(numbers)) for w in texts[d][a : a + n]] + [-1 - k])
        at += n + 1
    starts = np.array(starts)
    for s, e, p in main_lorentz(np.array([x for part in ids for x in part], np.int64), starts, starts + high - low, least, times).tolist():
        k = int(np.searchsorted(starts, s, "right")) - 1
        out[own[k]].append((int(first[k] + s - starts[k]), e - s, p))
    return out


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that are in no run, or in the first period of every run that has them, joined by one blank."""
    if runs:
        gone = np.zeros(len(text) + 1, np.int32)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        text = [w for w, g in zip(text, np.cumsum(gone).tolist()) if not g]
    return b" ".join(text)


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period) and collapsed (the text without what its runs repeat)
    of every row of docs."""

    def done(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, least, times)
        flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
        rest = pa.array([collapsed(w, x) for w, x in zip(texts, found)], pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays([ids, pa.array([len(w) for w in texts], pa.int64()), lists, rest], ["doc_id", "n_words", "runs", "collapsed"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            raw, texts, at, n = b.column(1).view(pa.binary()), [], 0, 0
            for i in range(len(b)):
                texts.append((raw[i].as_py() or b"").split())  # bytes: split at the six ASCII spaces
                n += len(texts[-1])
                if n >= WORDS or i == len(b) - 1:
                    yield done(b.column(0).slice(at, len(texts)), texts)
                    texts, at, n = [], i + 1, 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length/period, exactly; of equal ones the first."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(more(r, best), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by a hash of doc_id, the words from some place on repeat with a period of their own."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def repeating(w: Column) -> Column:
        g, n = F.expr("h div 10"), F.size(w).cast("long")
        return let(
            F.struct((g % n).alias("a"), (F.lit(1) + F.floor((n - g % n) / (g % 8 + 3))).alias("p")),
            lambda x: F.array_join(F.transform(w, lambda v, i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "),
        )

    text = F.when((F.col("h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), let(words(F.col("text")), repeating)).otherwise(F.col("text"))
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumn("best", strongest(F.col("runs")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

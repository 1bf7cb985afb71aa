"""Language identification with blended-spectrum presence kernels, Nystrom landmarks and kernel ridge regression.

A text's features are the presence of its byte n-grams of LENGTHS, lower-cased, white space runs as one blank. The kernel of
two texts is the number of n-grams both have over the root of the product of their numbers. Nystrom's method maps a text to
its kernels with LANDMARKS texts, whitened; one-versus-rest ridge regression on that map scores each language. A landmark's
n-grams are a row of ones, so the kernels of a batch of texts are one matrix product of presences, and their scores another.

The model is fitted on the driver on a bounded sample of labelled rows, chosen by a hash of id and text: at most SAMPLE texts of each
language, and fewer of each, but one at least, where there are more than BUDGET / SAMPLE languages. Landmarks are taken from the
languages in turn, so a rare language has its own. Every text, whole, is then scored where it lies.

Defined results: null text, or no letter: `und` with score 0; no labelled row at all: `und` for all; ties: the language first
in code-point order; repeated rows are scored each, and learned from once; rows that share an id, or
have none, are rows like any other; null doc_id: not held out; very long texts
are read in full, in pieces; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Labelled texts that the model is fitted on at most, of a language and in all; landmarks in all, but one for each language at least.
SAMPLE, BUDGET, LANDMARKS = 300, 60_000, 192
LENGTHS = (1, 2, 3)
RIDGE = 1e-2
#: n-grams are told apart by a hash of so many bits; those of one or two bytes never collide with each other.
BITS = 18
FOLD = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def present(text: bytes) -> np.ndarray:
    """Sorted distinct n-gram numbers of a whole text."""
    found = np.zeros(1 << BITS, bool)
    step = 1 << 20
    for at in range(0, len(text), step):  # pieces overlap by the longest n-gram less one
        data = _LOWER[np.frombuffer(text, np.uint8, min(len(text), at + step + max(LENGTHS) - 1) - at, at)]
        data = data[np.concatenate([[True], (data[1:] != 32) | (data[:-1] != 32)])].astype(np.uint32)
        for n in LENGTHS:
            code = np.zeros(max(0, len(data) - n + 1), np.uint32)
            for i in range(n):
                code = code * np.uint32(256) + data[i : len(data) - n + 1 + i]
            if n <= 2:
                found[code + (n - 1) * 256] = True
            else:
                found[(1 << 17) + ((code * np.uint32(2654435761)) >> np.uint32(32 - 17))] = True
    return np.flatnonzero(found)


class Model:
    """languages; landmarks (n-grams by landmark, scaled); weights (landmark by language)."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(labels))
        grams = [present(t) for t in texts]
        marks = landmark_rows(texts, labels, landmarks)
        own = np.unique(np.concatenate([grams[i] for i in marks]))  # other n-grams are in no landmark
        self.number = np.full(1 << BITS, -1, np.int32)
        self.number[own] = np.arange(len(own))
        self.marks = np.zeros((len(own), len(marks)), np.float32)
        for k, i in enumerate(marks):
            self.marks[self.number[grams[i]], k] = 1 / np.sqrt(max(1, len(grams[i])))
        kernels = self.kernels(grams)
        values, vectors = np.linalg.eigh(kernels[marks].astype(float))
        keep = values > 1e-6 * values.max()
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        x = np.hstack([kernels @ whiten, np.ones((len(texts), 1))])
        y = np.where(np.array(labels)[:, None] == np.array(self.languages), 1.0, -1.0)
        solved = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
        self.weights, self.bias = (whiten @ solved[:-1]).astype(np.float32), solved[-1]

    def kernels(self, grams: list[np.ndarray]) -> np.ndarray:
        """One row per text, one column per landmark: a product of presences with landmarks, a batch of texts at a time."""
        out = np.zeros((len(grams), self.marks.shape[1]), np.float32)
        for at in range(0, len(grams), 256):
            batch = grams[at : at + 256]
            presence = np.zeros((len(batch), len(self.marks)), np.float32)
            for i, g in enumerate(batch):
                n = self.number[g]
                presence[i, n[n >= 0]] = 1 / np.sqrt(max(1, len(g)))
            out[at : at + 256] = presence @ self.marks
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        """The best language of each text, and its share of the margins as a score from 0 to 1."""
        if not texts:
            return [], np.empty(0)
        margins = self.kernels([present(t) for t in texts]) @ self.weights + self.bias
        share = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        best = margins.argmax(axis=1)
        return [self.languages[i] for i in best], (share / share.sum(axis=1, keepdims=True))[np.arange(len(best)), best].astype(float)


def landmark_rows(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS) -> list[int]:
    """The languages' texts in turn, each language's in the order of their hashes, until there are enough and one of each."""
    turn: dict[str, int] = {}
    placed = []
    for i in sorted(range(len(texts)), key=lambda i: (hash_of(texts[i]), i)):
        turn[labels[i]] = turn.get(labels[i], -1) + 1
        placed.append((turn[labels[i]], hash_of(texts[i]), i))
    return [i for _, _, i in sorted(placed)[: max(landmarks, len(turn))]]


def hash_of(text: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, 3)


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == FOLD


def labelled_sample(docs: DataFrame, each: int = SAMPLE, budget: int = BUDGET) -> DataFrame:
    """text, lang of at most `each` rows of every language that are not held out: those with the smallest hash of id and text, equal rows
    once.

    A first pass counts the different hashes of each language and keeps only those below the share that gives about twice as many as
    needed (and some more, lest a small number be missed by chance), so no language is sorted whole, and none is missed because its rows
    share an id or a text.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out()).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("sample")).alias("row"))
    place = F.shiftrightunsigned(F.xxhash64("row"), 11) / F.lit(float(1 << 53))
    counts = stash(usable.select("lang", "row").distinct().groupBy("lang").agg(F.count("*").alias("n")))
    each = max(1, min(each, budget // max(1, counts.count())))
    near = usable.withColumn("place", place).join(counts, "lang").where(F.col("place") * F.col("n") <= 2 * each + 30)
    once = near.groupBy("lang", "row", "place").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "row"))
    return once.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text")


def fit(docs: DataFrame) -> Model | None:
    rows = labelled_sample(docs).collect()  # at most BUDGET, or one for each language
    rows = sorted((r["lang"], r["text"]) for r in rows)
    return Model([_bytes(t) for _, t in rows], [k for k, _ in rows]) if rows else None


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; only text is looked at for the last two."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS columns of at most 2^BITS numbers

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in it:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                lettered = np.array([x.as_py() for x in part.column(3)], bool) & (m is not None)
                best, score = (m.predict([_bytes(part.column(2)[int(i)].as_py()) for i in np.flatnonzero(lettered)])) if lettered.any() else ([], [])
                names, scores = np.full(len(part), "und", object), np.zeros(len(part))
                names[lettered], scores[lettered] = best, score
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names.tolist(), pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", is_held_out().alias("held_out"), "text", letter.alias("letter")).mapInArrow(batches, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))

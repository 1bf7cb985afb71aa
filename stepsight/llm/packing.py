"""Packing token sequences by shortest-pack-first over the length histogram.

Documents are cut into full sequences and one rest. Only the histogram of the lengths (at most LENGTH rows, whatever the
corpus size) goes to the driver, which places lengths longest first, many at a time, into the open pattern with the most room,
updating how many packs have each pattern. Patterns come back as intervals of ranks: the r-th piece of its length finds its
sequence and offset in the interval that holds r. Ranks come from counts by hash group, so pieces of one length, however many,
are ranked in many tasks.

Defined results: null text is empty; an empty document is its end id alone; rows that repeat a doc_id are documents of their
own; ties of length are ranked by a hash of id and start; very long texts give many pieces; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash
from .tokens import crc32, encoder

LENGTH = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one hash group, about: those of one length and group are ranked in one task.
GROUP = 50_000
#: Intervals of ranks up to which they are broadcast; they are bounded by the lengths, not by the corpus.
INTERVALS = 200_000
PIECE = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
Pattern = tuple[int, ...]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every row's ids and the end id, cut into pieces of `length` ids and a rest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for b in it:
            at = 0
            for ids, offsets in tokens.encode(b.column(1)):
                rows = []
                for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own, n = np.append(ids[lo:hi], tokens.kind.type(end)), hi - lo + 1
                    rows += [(at + i, s, min(length, n - s), crc32(own[s : s + length]), n) for s in range(0, n, length)]
                who, *rest = (np.array(x, np.int64) for x in zip(*rows))
                at += len(offsets) - 1
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), *map(pa.array, rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, PIECE.format(kind=kind))


def patterns(histogram: dict[int, int], length: int = LENGTH) -> Counter[Pattern]:
    """How many packs have each pattern (lengths, longest first). Shortest pack first: a length goes to the packs with the most room."""
    room: dict[int, Counter[Pattern]] = defaultdict(Counter)
    room[length] = Counter()
    for n, left in sorted(histogram.items(), reverse=True):
        while left:
            free = max((r for r, x in room.items() if x and r >= n and r < length), default=length)
            pattern, packs = next(iter(room[free].items())) if free < length else ((), left)
            take = min(left, packs)
            if free < length:
                room[free][pattern] -= take
                if not room[free][pattern]:
                    del room[free][pattern]
            room[free - n][(*pattern, n)] += take
            left -= take
    return sum((Counter(x) for x in room.values()), Counter())


def places(found: Counter[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset): pieces of that length and those ranks go to successive sequences."""
    rank, out, first = Counter(), [], 0
    for pattern, packs in sorted(found.items()):
        offset = 0
        for n in pattern:
            out.append((n, rank[n], rank[n] + packs - 1, first, offset))
            rank[n] += packs
            offset += n
        first += packs
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path or tokenizer_path(TOKENIZER), length, end))
    group = F.pmod(F.xxhash64("doc_id", "start"), F.lit(cut.count() // GROUP + 16))
    counts = stash(cut.groupBy("length", group.alias("group")).agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    table = places(patterns(histogram, length))
    before = counts.select("length", "group", (F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy(F.xxhash64("start", "doc_id"), "doc_id", "start"))
    ranked = cut.withColumn("group", group).withColumn("own", own).join(before, ["length", "group"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    spans = spark.createDataFrame(table, "length bigint, low bigint, high bigint, first bigint, offset bigint")
    at = ranked.join(F.broadcast(spans) if len(table) <= INTERVALS else spans, "length").where(F.col("rank").between(F.col("low"), F.col("high")))
    return at.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

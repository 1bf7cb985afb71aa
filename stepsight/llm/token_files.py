"""Token ids in Parquet list columns, in ascending doc_id order, for selective reads of tokens and of metadata.

Texts are encoded where they lie; only ids move. Ranges of doc_id come from a read of that column alone.

Layout of a row: doc_id, part and pos (place in the order), n_tokens, ids (list of int). Ids are dictionary-encoded (a page of
ids costs 16 bits each or less), the ascending numbers delta-encoded; row groups and pages are kept small and carry page
indexes, so a filter on doc_id reads few pages, and lengths or offsets are read without touching ids.

Defined results: null or empty text gives the end id alone; rows that repeat a doc_id (ties) stand side by side in any order, all in
one file; null doc_ids come first; very long texts are one list each; an empty table gives an empty file; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .packing import tokenizer_path
from .tokens import crc32, encoder

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Bytes of a row group and of a page.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
#: Rows of a file, about, as long as that makes no more than FILES files; then files grow instead, so that what cuts them stays bounded
#: (cuts in the plan, entries of the percentile sketch, sampled text ids: each some tens a file).
ROWS, FILES = 10_000, 20_000


def ranges(docs: DataFrame, size: int) -> list:
    """Ascending values of doc_id that cut docs into ranges of about `size` rows, FILES ranges at most."""
    n = docs.count()
    cuts = min(FILES, max(1, -(-n // size)))
    shares = [i / cuts for i in range(1, cuts)]
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        found = docs.select(F.percentile_approx("doc_id", shares or [0.5], max(10_000, 10 * cuts))).first()[0]
        return sorted(set(found or [])) if shares else []
    drawn = docs.where("doc_id IS NOT NULL").select("doc_id").sample(min(1.0, 20 * cuts / max(1, n)), 1).distinct().orderBy("doc_id").collect()
    return [drawn[int(len(drawn) * s)][0] for s in shares] if drawn else []


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, rows_per_file: int = ROWS) -> None:
    """Encodes every row's text and writes the files; their names ascend with doc_id."""
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)

    cuts = ranges(docs.select("doc_id"), rows_per_file)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bounds = encoder(tokenizer), np.array(cuts)
        for b in it:
            which, known = np.zeros(len(b), np.int32), b.column(0).is_valid()
            if len(cuts):
                which[known.to_numpy(zero_copy_only=False)] = np.searchsorted(bounds, b.column(0).filter(known).to_numpy(zero_copy_only=False), "right")
            at = 0
            for ids, offsets in tokens.encode(b.column(1)):
                k = len(offsets) - 1
                lists = pa.ListArray.from_arrays(pa.array(offsets + np.arange(k + 1), pa.int32()), pa.array(np.insert(ids.astype(np.int32), offsets[1:], end)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, k), pa.array(which[at : at + k]), lists], ["doc_id", "range", "ids"])
                at += k

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, range int, ids array<int>")
    ordered = encoded.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("doc_id")
    part = F.spark_partition_id().cast("long")
    rows = ordered.select("doc_id", part.alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), F.size("ids").cast("long").alias("n_tokens"), "ids")
    writer = rows.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size", PAGE).option("parquet.writer.version", "PARQUET_2_0")
    for column in ("doc_id", "part", "pos", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def starts(stored: DataFrame) -> DataFrame:
    """part, pos, start: ids of all documents before each, from the lengths alone."""
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))  # one row for each file
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return stored.select("part", "pos", own.alias("own")).join(before, "part").select("part", "pos", (F.col("before") + F.col("own")).alias("start"))


def digests(stored: DataFrame) -> DataFrame:
    """doc_id, part, pos, n_tokens and ids_crc32, from the ids as read."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(3)
            ids, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            crc = [crc32(ids[i:j]) for i, j in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "part", "pos", "ids").mapInArrow(batches, f"doc_id {kind}, part bigint, pos bigint, n_tokens bigint, ids_crc32 bigint")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    stored = spark.read.parquet(path)
    return digests(stored).join(starts(stored.select("part", "pos", "n_tokens")), ["part", "pos"]).select("doc_id", "start", "n_tokens", "ids_crc32")

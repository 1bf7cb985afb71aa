"""Exact dedup that treats frequent contents apart.

Every row becomes its SHA-256 digest, its doc_id and a row number, in a table of its own, so texts are read once. A Misra-Gries summary
(Spark's frequent-items sketch: a bounded number of counters, to which all are lowered when they run out, partial ones merged in a
tree) names the digests that may stand for more than one in FREQUENT rows; no such digest is missed. Their exact counts and winners,
at most FREQUENT rows, verify them and are broadcast: rows of verified digests are judged where they lie. All others, in groups of less
than that share, go through an ordinary shuffle by digest.

Defined results: null text counts as empty; of equal texts the row with the largest doc_id stays (null ids count as smallest; of
repeats of that id, and of rows without any id, one stays); the empty text is a text like any other; very long texts are digested whole;
an empty table gives no rows; other columns, whatever their names, are ignored by groups() and kept by keep_last().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: A digest of more than one in so many rows is frequent: that many are broadcast at most.
FREQUENT = 1024
#: Counters of a summary. It is wrong by less than 3.5 / 8192 of the rows, and names what lies twice that above zero.
COUNTERS = 8 * FREQUENT
#: Summaries that one task merges at most, about.
MERGED = 128
Normalise = Callable[[Column], Column]


def digest(text: Column, normalise: Normalise | None = None) -> Column:
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(normalise(whole) if normalise else whole, 256))


def digests(docs: DataFrame, normalise: Normalise | None = None) -> DataFrame:
    """doc_id, digest and row (a number of its own) of every row."""
    return stash(docs.select("doc_id", digest(F.col("text"), normalise).alias("digest"), F.monotonically_increasing_id().alias("row")))


def candidates(found: DataFrame) -> DataFrame:
    """key (a hash of a digest): every digest of more than one in FREQUENT rows is among them, and at most FREQUENT are."""
    parts = found.select(F.xxhash64("digest").alias("key"), F.spark_partition_id().alias("part"))
    sketches = parts.groupBy(F.floor(F.col("part") / MERGED).alias("part")).agg(F.expr(f"approx_top_k_accumulate(key, {COUNTERS}) AS s"))
    for by in (MERGED, MERGED, 1 << 40):  # the last is one group, or none of an empty table
        sketches = sketches.groupBy(F.floor(F.col("part") / by).alias("part")).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS}) AS s"))
    return sketches.select(F.explode(F.expr(f"approx_top_k_estimate(s, {FREQUENT})")).alias("t")).select(F.col("t.item").alias("key"))


def frequent(found: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, group_size of the digests that more than one in FREQUENT rows have: exact, at most FREQUENT rows."""
    near = found.join(F.broadcast(stash(candidates(found))), F.xxhash64("digest") == F.col("key"), "left_semi")  # at most FREQUENT keys
    winner = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")).alias("w")
    counted = near.groupBy("digest").agg(winner, F.count("*").alias("group_size"))
    return stash(counted.where((F.col("group_size") > 1) & (F.col("group_size") * FREQUENT > found.count())).select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), "group_size"))


def groups(docs: DataFrame, normalise: Normalise | None = None) -> DataFrame:
    """doc_id, digest, keep_id (doc_id of the row that stays), group_size, kept of every row of docs."""
    found = digests(docs, normalise)
    hot = F.broadcast(frequent(found))
    many = found.join(hot, "digest").select("doc_id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    whole = Window.partitionBy("digest")
    order = whole.orderBy(F.desc_nulls_last("doc_id"), F.desc("row"))
    few = found.join(hot, "digest", "left_anti").select("doc_id", "digest", F.first("doc_id").over(order).alias("keep_id"), F.count("*").over(whole).alias("group_size"), (F.row_number().over(order) == 1).alias("kept"))
    return many.unionByName(few)


def keep_last(docs: DataFrame, normalise: Normalise | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Copies of frequent texts go where they lie."""
    judged = groups(docs, normalise)
    stay = judged.where("kept").select(F.col("digest").alias("kept_digest"), F.col("doc_id").alias("kept_id"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), digest(F.col("text"), normalise).alias("digest"))
    kept = own.join(stay, (F.col("digest") == F.col("kept_digest")) & F.col("id").eqNullSafe(F.col("kept_id")), "left_semi")
    return kept.dropDuplicates(["digest", "id"]).select("doc.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

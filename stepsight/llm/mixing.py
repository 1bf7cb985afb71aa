"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words; its place in its source is a hash of its id. Sizes are summed by source and hash
bucket; the bucket in which a source's budget runs out is refined by the next bits of the hash, until the budget is met up to
one document. Selection is then a comparison of two numbers per row: nothing is sorted, and a source that holds most rows is
spread over buckets and pre-aggregated before any shuffle.

A target above the source's size takes every document once and, by the threshold, some twice: budgets nest.

Defined results: a null or empty text, or one without a word, has size 0 and is taken 0 words; mix() drops it, as it adds nothing to
the mix; null source is a source of its own, last; rows that repeat a doc_id share its hash (ties of places) and are taken alike; a
very long text that no budget ends within is taken if less than half of it lies beyond; an empty table gives no rows; further
columns are kept by mix(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, stash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of the hash that one level of the histogram looks at, and levels.
BITS, LEVELS = 12, 4


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds `target` to rows (key, source_size).

    Sources in the order of key get the weights in turn and share `share` times the sum of all sizes; a target stops at `most`
    times its source's size and the excess is shared again by weight. At the end every source below its stop has the same
    target per weight, so the stops that bind are those with the smallest most * size / weight: a running sum over sources in
    that order finds them without iteration. There is one row for each source, so these windows are small.
    """
    stop, level = F.col("stop"), F.col("level")
    order = Window.orderBy("stop", "key")
    earlier = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spare = share * F.sum("source_size").over(Window.partitionBy()) - most * earlier
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    return (
        sources.withColumn("w", weight)
        .withColumn("stop", most * F.col("source_size") / F.col("w"))
        # The target per weight if all sources before this one stop and no other; right for the first source that it doesn't stop.
        .withColumn("level", spare / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.min_by(F.when(level <= stop, level), F.when(level <= stop, stop)).over(Window.partitionBy()))
        .select("key", "source_size", F.least(F.coalesce(level, stop), stop) * F.col("w"))
        .toDF("key", "source_size", "target")
    )


def place() -> Column:
    """Hash of a row's id and text, 63 bits: rows that share an id, or have none, have places of their own."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit("mix")), 1)


def key() -> Column:
    """Of a row's source: sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, place, size of every row."""
    size = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", key().alias("key"), place().alias("place"), size.alias("size"))


def thresholds(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """key, source_size, target, whole (times that every document is taken), cut (those with place < cut are taken once more)."""

    def histogram(rows: DataFrame, shift: int) -> DataFrame:
        return rows.groupBy("key", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("size"))

    shift = 63 - BITS
    buckets = stash(histogram(sized, shift))
    want = targets(buckets.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share)
    want = stash(want.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)))
    edge = want.select("key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        summed = buckets.join(edge.select("key", "left"), "key").withColumn("sum", F.sum("size").over(Window.partitionBy("key").orderBy("bucket")))
        over = F.col("sum") > F.col("left")
        # The boundary bucket is the first that does not fit whole; at the last level, the first of which less than half fits.
        step = summed.groupBy("key", "left").agg(
            F.min(F.when(F.col("sum") - F.col("size") / 2 > F.col("left") if last else over, F.col("bucket"))).alias("bucket"),
            F.max("bucket").alias("top"),
            F.coalesce(F.max(F.when(~over, F.col("sum"))), F.lit(0)).alias("used"),
        )
        edge = stash(step.select("key", (F.col("left") - F.col("used")).alias("left"), F.coalesce("bucket", F.col("top") + (1 if last else 0)).alias("bucket")))
        if not last:
            inside = sized.join(edge.select("key", F.col("bucket").alias("_b")), "key").where(F.shiftright("place", shift) == F.col("_b"))
            shift -= BITS
            buckets = histogram(inside, shift)
    return want.join(edge.select("key", F.shiftleft("bucket", shift).alias("cut")), "key")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs."""
    sized = stash(sizes(docs))
    times = F.col("whole") + (F.col("place") < F.col("cut")).cast("int")
    return sized.join(thresholds(sized), "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    times = (F.col("whole") + (F.col("place") < F.col("cut")).cast("int")).cast("int")
    own = docs.where(F.col("text").rlike(f"[^{SPACE}]")).select(key().alias("key"), place().alias("place"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = own.join(thresholds(stash(sizes(docs))), "key")
    return joined.select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")

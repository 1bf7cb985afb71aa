"""What several operators share: tables in the shared folder, words, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir

#: Characters that separate words, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def stash(df: DataFrame, *by: str) -> DataFrame:
    """Writes df as Parquet to the shared folder (a folder for each value of `by`) and reads it back: cuts lineage, is computed
    once, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def words(text: Column) -> Column:
    """Array of the `[^\\x20\\x09-\\x0D]+` of a text; null: empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, though body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: rows (node, root) for every node of `edges` (a, b: bigint).

    Alternates large-star and small-star steps (each a grouped minimum and an equi-join, so a hub's edges can be split
    over tasks) until nothing changes; root is the smallest node of the component. Self-loops are fine and keep a lone node.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        e = small.select("x.a", F.col("x.m").alias("b")).where("a <> b").distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixed point")
    return nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))

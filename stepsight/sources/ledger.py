"""A ledger of transcripts that were read (path, size, time), so a run reads only new or grown ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import exists, shared_dir
from .sessions import read_lines

ENTRY = "path string, length bigint, time timestamp"


def files(spark: SparkSession, glob: str) -> DataFrame:
    """path (spelled as read_lines() has it: a space is %20), length, time of the files there are; their contents are not read."""
    return spark.read.format("binaryFile").load(glob).select(F.col("_metadata.file_path").alias("path"), "length", F.col("modificationTime").alias("time"))


def known(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(ENTRY).parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], ENTRY)


def unread(spark: SparkSession, glob: str, ledger: str) -> DataFrame:
    """path, length, time of files that the ledger does not have as they are now: new, grown or written anew."""
    return files(spark, glob).join(known(spark, ledger), ["path", "length", "time"], "left_anti")


def read_unread(spark: SparkSession, glob: str, ledger: str) -> tuple[DataFrame, DataFrame]:
    """The lines of unread transcripts, as read_lines() has them, and the entries to give to noted() once they are dealt with.

    Files older than all unread ones are not opened, as their time is held against the listing; of those younger only unread ones are kept.
    The entries are listed once, into a table of the shared folder: each further look at them would be one at every file. Its files, and
    so the ledger's, are as many as its size asks for, not one for each few transcripts."""
    path = f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}"
    unread(spark, glob, ledger).hint("rebalance").write.parquet(path)
    entries = spark.read.schema(ENTRY).parquet(path)
    since = entries.agg(F.min("time").alias("t")).first()["t"]
    lines = read_lines(spark, glob, since)
    return lines.join(entries.select("path"), "path", "left_semi"), entries


def noted(entries: DataFrame, ledger: str) -> None:
    """Adds what was read to the ledger. Call it after the results are written: a run that fails between reads the files again."""
    entries.write.mode("append").parquet(ledger)

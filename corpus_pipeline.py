"""Cleans, mixes and packs `documents`: each stage reads what the stage before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepsight.jobs.session import ship
from stepsight.llm import common, mixing, near_copies, packing, quality, secret_scan


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go, among them null and empty texts; rows are judged each, whatever their ids; an
    empty table stays empty; all columns are kept, whatever their names. So in all stages but the last."""
    ship(spark)
    return quality.keep_good(docs)


def _near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash at 4 or fewer bits as in operator 2, or five-word shingles with a similarity of
    0.8 or more) stays: that with the smallest doc_id, nulls last. Repeated rows are copies; null texts are copies of each other and of empty ones."""
    ship(spark)
    return near_copies.keep_one(docs)


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text, and n_chars follows; null texts stay null."""
    ship(spark)
    return secret_scan.redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: never, once or twice; null source is a source; texts without words go."""
    ship(spark)
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null texts are empty, an empty one is its end id; other columns go."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality_rules", _quality), ("simhash_near_dedup", _near_copies), ("secret_scans", _secrets), ("mixing", _mixing), ("packing", _packing)]

#: SQL can express neither the learned stages nor the tokenizer; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stash(docs)
    return docs

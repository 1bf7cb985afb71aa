"""Exact dedup against a dict of texts, its summary against exact counts, and odd inputs."""

import collections
import hashlib

import numpy as np
from pyspark.sql import functions as F

from stepsight.llm import exact_dedup

from .test_operators import DOCS, corpus, empty, table


def by_force(rows):
    """(doc_id, keep_id, group_size, kept, digest) of (doc_id, text) rows; of rows that repeat the largest id one is kept."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), at == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for at, i in enumerate(ids)]
    return collections.Counter(out)


def rows_of(df):
    return collections.Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in df.collect())


def test_groups_by_force(spark):
    rng = np.random.default_rng(1)
    texts = corpus() + [f"t{x}" for x in rng.integers(0, 40, 150)] + ["the same everywhere"] * 90 + ["Case", "case", "x ", "x"]
    assert rows_of(exact_dedup.groups(table(spark, texts).repartition(7))) == by_force(list(enumerate(texts)))


def test_frequent_and_rare_groups_alike(spark, monkeypatch):
    """The same rows whether a group is frequent or not."""
    monkeypatch.setattr(exact_dedup, "FREQUENT", 4)
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 7 == 0 else f"u{i // 2}") for i in range(400)]
    docs = spark.createDataFrame([(i, t, "l", "s", 0, "k", 7, "d") for i, t in rows], DOCS).repartition(9)
    found = exact_dedup.digests(docs)
    assert [r["group_size"] for r in exact_dedup.frequent(found).collect()] == [134]
    assert rows_of(exact_dedup.groups(docs)) == by_force(rows)


def test_summary_misses_no_frequent_digest(spark):
    """Skewed counts over many partitions, far more digests than counters: every one above the share is named."""
    values = spark.range(0, 300_000, 1, 300).select(F.when(F.col("id") % 4 == 0, F.col("id") % 400).otherwise(F.col("id")).alias("v"), "id")
    found = values.select(F.col("id").alias("doc_id"), F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("digest"), F.col("id").alias("row"))
    want = {r["digest"] for r in found.groupBy("digest").count().where("count * 1024 > 300000").collect()}
    got = exact_dedup.frequent(found).collect()
    assert len(want) == 100 and {r["digest"] for r in got} == want and all(r["group_size"] == 750 + (r["keep_id"] < 400) for r in got)
    assert exact_dedup.candidates(found).count() <= exact_dedup.FREQUENT


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "a"), (None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (7, None), (8, ""), (9, "c"), (2, "long " * 300_000), (1, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, "l", "s", 0, "digest", 7, "row") for i, t in rows], DOCS.replace("key", "digest").replace(" h ", " group_size "))
    judged = exact_dedup.groups(docs)
    assert rows_of(judged) == by_force(rows)
    kept = exact_dedup.keep_last(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in kept.collect()) == [(0, 1), (2, 1_500_000), (5, 1), (8, 0), (9, 1)]


def test_normalised_texts_and_empty_tables(spark):
    docs = table(spark, ["Some  Text", "some text", "other", None, "  "])
    plain = exact_dedup.groups(docs, lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))))
    assert {r["doc_id"]: r["keep_id"] for r in plain.collect()} == {0: 1, 1: 1, 2: 2, 3: 4, 4: 4}
    assert exact_dedup.groups(empty(spark)).count() == exact_dedup.keep_last(empty(spark)).count() == 0


def test_no_python_and_one_exchange_of_rows(spark):
    plan = exact_dedup.groups(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1

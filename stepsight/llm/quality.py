"""Quality rules as weak supervision, in DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the histogram of vote patterns (at most
3^rules rows, whatever the corpus size) estimates how each rule votes on good and on bad documents and the share of either;
a document's posterior probability of being good replaces an all-must-pass filter.

Defined results: null or empty text has no words, so base_failed is true and kept false; repeated rows and ties are
judged row by row; very long texts cost n log n; an empty table gives no rows; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, let, stash, words

# Function words of the four languages of the corpus.
STOP_WORDS = "the of and to in is that it for on with as at by this der die und das den von zu mit für ist ein eine les des le la un une en pour que est qui dans el los las una por con para del se no".split()
#: Features that every document gets.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EM_ROUNDS = 25


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the word array w, first ones included."""

    def covered(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(F.transform(p, lambda x, k: F.when(k == n - 1, 3).otherwise(F.least(F.lit(3), F.get(p, k + 1) - x))), F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        return let(F.sort_array(F.transform(F.filter(s, lambda e, k: (F.get(s, k - 1)["g"] == e["g"]) | (F.get(s, k + 1)["g"] == e["g"])), lambda e: e["i"])), covered)

    def counted(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(let(F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), twice))

    grams = F.when(F.size(w) < 4, F.expr("cast(array() as array<bigint>)")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return let(grams, counted)


def features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """One row per document: `doc`, a struct of the columns in carry; BASE; further columns that only the rules read."""
    t = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("doc"), t.alias("t"), words(t).alias("w"), lines.alias("lines"))
    return df.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        let(F.col("w"), repeat_words).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.regexp_count("t", F.lit(r"\p{Lu}{2,}[!?]")).cast("long").alias("n_shouts"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, STOP_WORDS)))).cast("long").alias("n_stop"),
    )


def rules() -> dict[str, Column]:
    """Name of each rule and its vote. Adding one needs no other change."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": F.when(F.col("n_words") >= 80, 1).otherwise(0),
        "symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 <= n),
        "repeats": vote(F.col("n_repeat_words") * 2 > n, F.col("n_repeat_words") * 5 < n),
        "lines": vote((F.col("n_dup_lines") * 3 > F.col("n_lines")) & (F.col("n_lines") > 3), F.col("n_dup_lines") * 10 <= F.col("n_lines")),
        "shouts": vote(F.col("n_shouts") * 5 > n, F.col("n_shouts") * 50 <= n),
        "variety": vote((F.col("n_distinct") * 5 < n) & (F.col("n_words") < 2000), F.col("n_distinct") * 3 >= n),
        "word_length": vote((F.col("word_chars") > 14 * n) | (F.col("word_chars") < 2 * n), F.col("word_chars").between(3 * n, 10 * n)),
        "function_words": vote((F.col("n_stop") == 0) & (F.col("n_words") >= 50), F.col("n_stop") >= 2),
    }


def fit(patterns: DataFrame, names: list[str], rounds: int = EM_ROUNDS) -> Column:
    """Posterior probability of being good, as a column over the votes in `names`, by expectation-maximisation.

    patterns: rows of votes and `n`, how many documents cast them: at most 3^rules rows, whatever the corpus size, which are collected
    once. The model has, for either class, a distribution over the three votes of each rule. The start takes any bad vote for a sign
    of a bad document. An empty table: the start.
    """
    rows = [(tuple(r[k] for k in names), r["n"]) for r in patterns.select(*names, "n").collect()]
    total = sum(n for _, n in rows)
    if not total:
        return F.when(F.array_contains(F.array(*names), -1), 0.2).otherwise(0.95)
    p = [0.2 if -1 in votes else 0.95 for votes, _ in rows]
    before = None
    for _ in range(rounds):
        good = sum(n * x for (_, n), x in zip(rows, p))
        prior = math.log((good + 1) / (total - good + 1))
        ratios: list[dict[int, float]] = []
        for i in range(len(names)):
            cast, well = {-1: 0.0, 0: 0.0, 1: 0.0}, {-1: 0.0, 0: 0.0, 1: 0.0}
            for (votes, n), x in zip(rows, p):
                cast[votes[i]] += n
                well[votes[i]] += n * x
            ratios.append({v: math.log((well[v] + 1) / (good + 3)) - math.log((cast[v] - well[v] + 1) / (total - good + 3)) for v in cast})
        p = [1 / (1 + math.exp(-max(-700.0, prior + sum(r[v] for r, v in zip(ratios, votes))))) for votes, _ in rows]
        if before is not None and abs(before - good) < 1e-6 * total:
            break
        before = good
    score = F.lit(prior)
    for k, ratio in zip(names, ratios):
        score = score + F.when(F.col(k) == -1, ratio[-1]).when(F.col(k) == 1, ratio[1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-score))


def judge(docs: DataFrame, least: float = 0.5, carry: list[str] = ["doc_id"]) -> DataFrame:
    """For every row of docs: `doc` (struct of the columns in carry), BASE, votes, quality (posterior), base_failed and kept."""
    named = rules()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = stash(features(docs, carry).select("doc", *BASE, failed.alias("base_failed"), *(c.cast("int").alias(k) for k, c in named.items())))
    patterns = voted.where("not base_failed").groupBy(*named).agg(F.count("*").alias("n"))
    return voted.withColumn("quality", fit(patterns, [*named])).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def keep_good(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with all columns of docs."""
    return judge(docs, least, docs.columns).where("kept").select("doc.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc.doc_id", *BASE, "base_failed", "kept", "quality")

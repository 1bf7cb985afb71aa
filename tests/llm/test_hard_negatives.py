"""Hard negatives against a sort of all scores; ties, repeated rows, odd vectors, several slabs."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from stepsight.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, q string, norm int, w int"


def by_force(rows, is_anchor, k=5, m=10, scale=256):
    own = [(i, lab, [math.floor(scale * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = collections.Counter()
    for a, lab, q in own:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), i, l2) for i, l2, r in own if len(r) == len(q))
        for s, p, _ in [x for x in scored if x[2] == lab and x[1] != a][:k]:
            near = [x for x in scored if x[2] != lab and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out.update((a, p, rank + 1, i, -s, -n) for rank, (n, i, _) in enumerate(near))
    return out


def mined(spark, rows, every=4, **more):
    df = spark.createDataFrame([(i, v, lab, "q", 1, 2) for i, v, lab in rows], SCHEMA)
    return collections.Counter(tuple(r) for r in hard_negatives.mine(df.repartition(5), F.col("vec_id") % every == 0, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(rng, n, dim=12, centres=6, labels=3):
    middle = rng.standard_normal((centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.5 * rng.standard_normal((n, dim))
    return [(i, list(map(float, v / np.linalg.norm(v))), int(rng.integers(labels))) for i, v in enumerate(x)]


def test_by_force(spark):
    rows = clustered(np.random.default_rng(1), 250)
    got = mined(spark, rows)
    assert got == by_force(rows, lambda i: i % 4 == 0) and len(got) > 1000


def test_refines_digits_and_ties(spark, monkeypatch):
    """Small digits and no slack: scores and then ids are refined to the last digit; most scores are ties."""
    monkeypatch.setattr(hard_negatives, "DIGIT", 2)
    monkeypatch.setattr(hard_negatives, "ENOUGH", 1)
    rng = np.random.default_rng(2)
    rows = [(int(i) * 37 - 900, [float(x) for x in rng.integers(0, 3, 2)], int(rng.integers(2))) for i in rng.permutation(160)]
    assert mined(spark, rows, scale=1) == by_force(rows, lambda i: i % 4 == 0, scale=1)


def test_one_vector_that_a_third_of_the_rows_have(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 120)
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(60)] + [(5000, rows[8][1], 1)] * 40  # and one row forty times
    assert mined(spark, rows, every=20) == by_force(rows, lambda i: i % 20 == 0)


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = clustered(rng, 60)
    rows += [(None, [1.0] * 12, 1), (64, None, 1), (68, [1.0] * 11 + [None], 1), (72, [float("nan")] * 12, 1), (76, [float("inf")] * 12, 1), (80, [1.0] * 12, None), (84, [], 1), (85, [], 2), (88, [0.0] * 12, 1), (92, [1.0, 2.0], 1), (93, [2.0, 1.0], 1), (94, [1.0, 1.0], 2)]
    assert mined(spark, rows) == by_force(rows, lambda i: i % 4 == 0)
    assert mined(spark, rows + [(100, [1e300] * 12, 1), (101, [-1e12] * 12, 2)]) == by_force(rows, lambda i: i % 4 == 0)
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert mined(spark, [(0, [1.0], 1)]) == collections.Counter()


def test_long_vectors_need_other_types(spark):
    rng = np.random.default_rng(5)
    for size in (1e3, 1e6):  # scores beyond the exact range of single and of double precision
        rows = [(i, [float(x) for x in rng.standard_normal(6) * size], int(rng.integers(2))) for i in range(80)]
        assert mined(spark, rows) == by_force(rows, lambda i: i % 4 == 0)


def test_text_labels_and_several_slabs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLAB", 7)
    rows = clustered(np.random.default_rng(6), 150)
    df = spark.createDataFrame([(i, v, f"label {lab}") for i, v, lab in rows], "vec_id int, embedding array<float>, label string")
    got = collections.Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 4 == 0).collect())
    floats = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert got == by_force(floats, lambda i: i % 4 == 0)

"""Periodic runs against a search over all places and periods."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from stepsight.llm import periodic_runs
from stepsight.llm.queries import QUERIES

from .test_operators import DOCS, WORD, corpus, empty, table


def by_force(w, least=24, times=3):
    """Every period, every maximal stretch that keeps it; of a stretch the smallest period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def stretches():
    rng = np.random.default_rng(5)
    out = [list(rng.choice(list("ab"), 300)), list(rng.choice(list("abc"), 200)), fibonacci(1500), ["x"] * 700, ["x"] * 23, ["x"] * 24, [], ["one"]]
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 30, int(rng.integers(1, 60)))]
        w = [f"v{x}" for x in rng.integers(0, 9, int(rng.integers(0, 50)))] + base * int(rng.integers(1, 6)) + base[: int(rng.integers(0, len(base) + 1))] + [f"v{x}" for x in rng.integers(0, 9, 20)]
        if rng.random() < 0.5:
            w[int(rng.integers(len(w)))] = "odd"
        out.append(w)
    inner = (["p", "q"] * 20 + [f"z{i}" for i in range(9)]) * 4  # runs within a run
    return [*out, inner, inner + ["end"] + inner]


def test_runs_by_force():
    texts = stretches()
    want = [by_force(w) for w in texts]
    assert sum(map(len, want)) > 60
    assert periodic_runs.runs_of([[x.encode() for x in w] for w in texts]) == want
    for w, x in zip(texts, want):  # alone, or with others
        assert periodic_runs.runs_of([[v.encode() for v in w]]) == [x]


@pytest.mark.parametrize(("least", "times"), [(6, 2), (10, 2), (9, 3), (40, 4)])
def test_other_lengths_and_exponents(least, times):
    texts = stretches()[:40]
    assert periodic_runs.runs_of([[x.encode() for x in w] for w in texts], least, times) == [by_force(w, least, times) for w in texts]


def test_mask_keeps_every_word_of_a_run():
    assert periodic_runs.overlap() == 16 == min(max(24, 3 * q) - q for q in range(1, 500))
    for w in stretches():
        ids = np.array([hash(x) for x in w], np.int64)
        kept = periodic_runs.repeated(ids, np.zeros(len(w), np.int64), 16)
        assert all(kept[s : s + n].all() for s, n, _ in by_force(w))
    rng = np.random.default_rng(6)
    two = np.concatenate([x := rng.integers(0, 1 << 60, 500), x])
    assert not periodic_runs.repeated(two, np.repeat([0, 1], 500), 16).any()  # what two documents share is no repeat


def planted(i, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def answer(w):
    found = by_force(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    texts = [t for t in corpus() if t is None or len(t) < 20_000] + [" ".join(w) for w in stretches()] + [" x y " * 30, "a\x0bb\x0c" * 20]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 999, int(n))) for n in rng.integers(1, 500, 150)]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == {i: answer(planted(i, t)) for i, t in enumerate(texts)}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 15


def test_query_on_given_documents(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_periodic_runs"](spark, data).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if len(w := planted(r["doc_id"], r["text"])) < 2000:
            assert got[r["doc_id"]] == answer(w)


def test_null_and_repeated_ids_long_texts_and_empty_tables(spark):
    long = " ".join(f"u{i}" for i in range(300_000)) + " " + "again and " * 200_000
    rows = [(None, "go " * 30), (None, None), (3, "go " * 30), (3, "go " * 30), (4, ""), (5, " \n\t"), (6, long)]
    got = periodic_runs.find(spark.createDataFrame([(i, t, "l", "s", 0, "k", 7, "runs") for i, t in rows], DOCS.replace("key", "runs").replace("doc string", "collapsed string")))
    found = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], len(r["collapsed"])) for r in got.collect()), key=str)
    once = [(0, 30, 1)]
    assert found == sorted([(0, 30, once, 2), (0, 0, [], 0), (3, 30, once, 2), (3, 30, once, 2), (4, 0, [], 0), (5, 0, [], 0), (6, 700_000, [(300_000, 400_000, 2)], len(long) - 1 - 10 * 199_999)], key=str)
    assert periodic_runs.find(empty(spark)).count() == 0

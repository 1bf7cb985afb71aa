"""The pipeline, stage by stage, against plain Python on what the stage before it wrote."""

import collections
import math
import re

import numpy as np
import pytest

from stepsight.llm import common, mixing, packing, quality, secret_scan

from .test_operators import DOCS, WORD, components_of, crc, prose

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def documents():
    rng = np.random.default_rng(51)
    texts = [prose(rng, int(n)) for n in rng.integers(60, 200, 60)]
    texts += [" ".join(w if i % 40 else "changed" for i, w in enumerate(t.split(" "))) for t in texts[:8]] + texts[8:12]
    texts += [f"{prose(rng, 70)} token = \"{SECRET}\" {prose(rng, 20)}" for _ in range(4)]
    texts += [" ".join(w + "###" for w in prose(rng, 90).split()) for _ in range(12)] + [None, "", " \n", "short text", "ab " * 300, prose(rng, 3000)]
    return [(i if i % 17 else (None if i % 34 else i), t, "en", ("a", "b", None, "c")[i % 4], len(t or ""), "k", 7, "d") for i, t in enumerate(texts)]


def votes(text):
    """Base verdict and votes of the quality rules, by plain Python."""
    t = text or ""
    w = WORD.findall(t)
    n = max(1, len(w))
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = collections.Counter(grams)
    repeat = len({i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    dup, symbols, chars = len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", t)), sum(map(len, w))
    shouts, stop, distinct = len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}[!?]", t)), len(set(w) & set(quality.STOP_WORDS)), len(set(w))
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    cast = (
        int(len(w) >= 80),
        vote(symbols * 10 > n, symbols * 50 <= n),
        vote(repeat * 2 > n, repeat * 5 < n),
        vote(dup * 3 > len(lines) > 3, dup * 10 <= len(lines)),
        vote(shouts * 5 > n, shouts * 50 <= n),
        vote(distinct * 5 < n and len(w) < 2000, distinct * 3 >= n),
        vote(chars > 14 * n or chars < 2 * n, 3 * n <= chars <= 10 * n),
        vote(stop == 0 and len(w) >= 50, stop >= 2),
    )
    return len(w) < 50 or 100 * repeat > 50 * len(w), cast


def kept_by_quality(texts):
    judged = [votes(t) for t in texts]
    rows = [c for failed, c in judged if not failed]
    p = {c: 0.2 if -1 in c else 0.95 for c in set(rows)}
    last = None
    for _ in range(quality.EM_ROUNDS):
        good, odds = sum(p[c] for c in rows), {}
        for c in p:
            odds[c] = math.log((good + 1) / (len(rows) - good + 1))
            for i, v in enumerate(c):
                same = [r for r in rows if r[i] == v]
                well = sum(p[r] for r in same)
                odds[c] += math.log((well + 1) / (good + 3)) - math.log((len(same) - well + 1) / (len(rows) - good + 3))
        p = {c: 1 / (1 + math.exp(-x)) for c, x in odds.items()}
        if last is not None and abs(last - good) < 1e-6 * len(rows):
            break
        last = good
    return [not failed and p[c] >= 0.5 for failed, c in judged]


def test_stages_follow_plain_python(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "mixing", "packing"]
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, at = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stash(stage(spark, docs, str(tmp_path)))
        at.append([r.asDict() for r in docs.collect()])
        assert name == "packing" or docs.columns == [c.split()[0] for c in DOCS.split(", ")]
    rows = lambda x: collections.Counter((r["doc_id"], r["text"]) for r in x)
    given = [dict(zip(("doc_id", "text", "lang", "source"), r)) for r in documents()]
    assert rows(at[0]) == rows(r for r, ok in zip(given, kept_by_quality([r["text"] for r in given])) if ok)
    assert len(at[0]) < len(given) - 10

    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in at[0] for w in [r["text"].lower().split()]]
    root = components_of(len(sets), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)])
    groups = collections.defaultdict(list)
    for r, x in zip(at[0], root):
        groups[x].append(r)
    assert len(at[1]) == len(groups) < len(at[0]) - 5
    for g in groups.values():
        known = [r["doc_id"] for r in g if r["doc_id"] is not None]
        kept = [r for r in at[1] if r["text"] in {x["text"] for x in g}]
        assert len(kept) == 1 and (not known or kept[0]["doc_id"] == min(known))

    def masked(r):
        parts, end = [], 0
        for a, b, p in secret_scan.found_in(r["text"], r["source"] or "", secret_scan.trained()):
            if p >= 0.5:
                parts, end = [*parts, r["text"][end:a], secret_scan.MASK], b
        return "".join([*parts, r["text"][end:]])

    assert rows(at[2]) == rows(r | {"text": masked(r)} for r in at[1])
    assert not any(SECRET in r["text"] for r in at[2]) and sum(secret_scan.MASK in r["text"] for r in at[2]) >= 3
    assert all(r["n_chars"] == len(r["text"]) for r in at[2] if secret_scan.MASK in r["text"])

    size = collections.Counter()
    for r in at[2]:
        size[r["source"]] += len(WORD.findall(r["text"]))
    order = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight, target, left, active = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(size.values()), set(order)
    while over := [s for s in active if left * weight[s] / sum(weight[x] for x in active) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
            left -= target[s]
            active.remove(s)
    target |= {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
    took = collections.Counter()
    for r in at[3]:
        took[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(took[s] - target[s]) <= max(len(WORD.findall(r["text"])) for r in at[2] if r["source"] == s) for s in order)
    assert set(rows(at[3])) <= set(rows(at[2])) and max(rows(at[3]).values()) <= 2

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    want = collections.Counter()
    for r in at[3]:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0]
        want.update((r["doc_id"], s, min(1024, len(ids) - s), crc(ids[s : s + 1024]), len(ids)) for s in range(0, len(ids), 1024))
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in at[4]) == want
    ends = collections.defaultdict(list)
    for r in at[4]:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    assert all([a for a, _ in sorted(x)] == [0, *(b for _, b in sorted(x))][:-1] and sorted(x)[-1][1] <= 1024 for x in ends.values())


def test_empty_table_passes_all_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_missing_shared_folder_is_an_error_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

"""The pipeline's similarity join on groups whose members resemble each other by a little more or a little less than 0.8."""

import numpy as np
from stepsight.llm import near_copies, simhash

from .test_operators import components_of, prose, table


def changed(rng, words, k, tag):
    w = list(words)
    for at in rng.choice(len(w), k, replace=False):
        w[at] = f"{tag}{rng.integers(1 << 30)}"
    return w


def resembling(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if len(a & b) >= 0.8 * len(a | b)]


def test_chains_and_crowds_of_one_band_value(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(4):  # each text resembles the next one only
        w = prose(rng, 200).split()
        for _ in range(10):
            texts.append(" ".join(w))
            w = changed(rng, w, 4, "c")
    base = prose(rng, 220).split()  # pairs of these are at 0.69 to 0.91
    texts += [" ".join(changed(rng, base, int(k), "d")) for k in rng.integers(1, 5, 60)]
    links = resembling(texts)
    assert 60 < len(links) < 2000
    kept = near_copies.keep_one(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(components_of(len(texts), links)))


def test_a_pair_is_held_against_each_other_once(spark, monkeypatch):
    """What goes to the shingle sets: no pair twice, in whatever pass, however many band values its texts share."""
    rng = np.random.default_rng(22)
    base = prose(rng, 220).split()
    texts = [" ".join(changed(rng, base, 3, "e")) for _ in range(40)]
    seen, verified = [], near_copies.verified

    def watched(own, pairs, least):
        seen.append([(r["a"], r["b"]) for r in pairs.collect()])
        return verified(own, pairs, least)

    monkeypatch.setattr(near_copies, "verified", watched)
    near_copies.keep_one(table(spark, texts)).collect()
    pairs = [frozenset(p) for x in seen for p in x]
    assert len(seen) == 4 and len(pairs) == len(set(pairs)) > 60


def test_every_link_of_simhash_holds(spark):
    """Texts whose fingerprints differ in 4 or fewer bits, though their shingle sets resemble each other by less than 0.8."""
    rng = np.random.default_rng(23)
    pairs = []
    while len(pairs) < 6:
        base = prose(rng, 60).split()
        for _ in range(300):
            other = changed(rng, base, 2, "s")
            a, b = " ".join(base), " ".join(other)
            if bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= 4 and not resembling([a, b]):
                pairs.append((a, b))
                break
    texts = [t for p in pairs for t in p] + [prose(rng, 60) for _ in range(5)]
    kept = near_copies.keep_one(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2, 4, 6, 8, 10, *range(12, 17)]
    links = simhash.near_duplicates(table(spark, texts)).select("component_id").distinct().collect()
    assert sorted(r["component_id"] for r in links) == sorted(r["doc_id"] for r in kept)

"""Languages and sources whose rows share an id or have none, and licenses in very long texts."""

import collections
import time

import numpy as np
from pyspark.sql import functions as F

from stepsight.llm import language, licenses, mixing

from .test_operators import DOCS, WORD, prose, table


def test_a_language_is_learned_whatever_its_ids(spark):
    rng = np.random.default_rng(51)
    kinds = {"aa": "ka lo mi ru te".split(), "bb": "sch en ung ei ver".split(), "cc": "ção ão es ar".split(), "dd": "xyz wyx".split()}
    word = lambda k: "".join(rng.choice(kinds[k], 3))
    rows = [(None, " ".join(word("aa") for _ in range(12)), "aa") for _ in range(3000)]  # no ids
    rows += [(i, " ".join(word("bb") for _ in range(12)), "bb") for i in range(3000)]
    rows += [(4, " ".join(word("cc") for _ in range(12)), "cc") for _ in range(3000)]  # one id
    rows += [(4, "xyzwyx xyzxyz wyxxyz", "dd")] * 3000  # one id and one text
    assert language.FOLD != 3  # id 4 is not held out
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    assert docs.where("doc_id = 4").where(language.is_held_out()).count() == 0
    sample = collections.Counter(r["lang"] for r in language.labelled_sample(docs).collect())
    assert sample["aa"] == sample["bb"] == sample["cc"] == language.SAMPLE and sample["dd"] == 1
    got = language.predict(docs, language.fit(docs)).withColumn("n", F.lit(1)).groupBy("doc_id", "lang_pred").count().collect()
    right = collections.Counter()
    for r in got:
        right[r["lang_pred"]] += r["count"]
    assert all(right[k] > 2900 for k in kinds)


def test_mixing_takes_part_of_a_source_without_ids(spark):
    rng = np.random.default_rng(52)
    rows = [(None, prose(rng, int(n)), "l", "a", 0, "k", 7, "d") for n in rng.integers(5, 40, 300)] + [(7, prose(rng, 20), "l", "b", 0, "k", 7, "d") for _ in range(400)] + [(i, prose(rng, 200), "l", "c", 0, "k", 7, "d") for i in range(60)]
    taken = mixing.taken(spark.createDataFrame(rows, DOCS)).collect()
    for s in "abc":
        own = [r for r in taken if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert any(0 < sum(r["taken"] for r in taken if r["source"] == s) % r["source_size"] for s in "abc" for r in taken[:1])
    assert WORD.findall("a b") == ["a", "b"]


def test_licenses_of_a_text_of_a_megabyte_of_notices(spark):
    notice, mit = "Released under the MIT License. ", licenses.TEMPLATES["MIT"]
    rng = np.random.default_rng(53)
    texts = [notice * 34_000, prose(rng, 60_000) + " " + mit + " " + prose(rng, 60_000), (mit + " ") * 1800]
    assert min(map(len, (texts[0], texts[2]))) > 900_000
    began = time.time()
    got = collections.defaultdict(set)
    for r in licenses.scan(table(spark, texts)).collect():
        got[r["doc_id"]].add(r["license"])
    assert "MIT-notice" in got[0] and "MIT" in got[1] and "MIT" in got[2]
    assert time.time() - began < 120

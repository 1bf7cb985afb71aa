"""Secrets and look-alikes of shapes that the labels do not make, key blocks of any length, and cuts of token files at many rows."""

import base64
import random
import time

import numpy as np
from pyspark.sql import functions as F
from stepsight.llm import secret_scan, token_files

from .test_operators import table

_RANDOM = random.Random(31)


def _base64(n):
    return base64.b64encode(_RANDOM.randbytes(n)).decode()


HARMLESS = [
    f'<img src="data:image/png;base64,{_base64(600)}">',
    f"background: url(data:image/gif;base64,{_base64(90)})",
    f'"integrity": "sha512-{_base64(64)}",',
    f"  integrity sha512-{_base64(64)}",
    'password = os.environ["DB_PASSWORD"]',
    "password = os.getenv('X')",
    "token = tokenizer.next_token()",
    "self.token = self.config.token",
    'secret = settings.get_secret("x")',
    "sequence " + "".join(_RANDOM.choice("ACGT") for _ in range(120)) + " end",
    "the password: please choose a longer one",
    "a secret: between friends",
    "id 550e8400-e29b-41d4-a716-446655440000 ok",
]
KEY = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(_base64(48) for _ in range(400)) + "\n-----END RSA PRIVATE KEY-----"
SECRET = [
    ("passphrase: Tr0ub4dor&3x", "Tr0ub4dor&3x"),
    ("pwd=s3cr3tPa55", "s3cr3tPa55"),
    ("token   :   9f8a7b6c5d4e3f2a1b0c9d8e", "9f8a7b6c5d4e3f2a1b0c9d8e"),
    ('password = "correcthorsebatterystaple"', "correcthorsebatterystaple"),
    ("password: hunter2", "hunter2"),
    (f"key {KEY} end", KEY),
    ("postgres://admin:" + "q2oXB8cp3vXm" * 15 + "@db/x", "q2oXB8cp3vXm" * 15),
]


def test_secrets_are_masked_and_look_alikes_stay(spark):
    texts = HARMLESS + [t for t, _ in SECRET]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == HARMLESS + [t.replace(v, secret_scan.MASK) for t, v in SECRET]


def test_key_blocks_end_where_they_should():
    head = "-----BEGIN PRIVATE KEY-----"
    cut = f"{head}\n{'A' * 64}\n{'B' * 64}\nno more of it, {head} - x - {KEY}"
    spans = [cut[a:b] for a, b in secret_scan.key_blocks(cut)]
    assert spans == [f"{head}\n{'A' * 64}\n{'B' * 64}", head, KEY]


def test_very_long_texts_are_scanned_in_proportion():
    judge = secret_scan.trained()

    def took(text):
        start = time.process_time()
        found = secret_scan.found_in(text, "s", judge)
        return time.process_time() - start, len(found)

    for unit in ("-----BEGIN PRIVATE KEY----- ", "pass : ://a:bcde ", "token = '9f8a7b6c5d4e3f2a1b0c9d8e' and so on ", "a.b" * 8 + " "):
        small, large = took(unit * 1000), took(unit * 8000)
        assert large[1] == 8 * small[1] and large[0] < 30 * small[0] + 1
    assert len(secret_scan.found_in("A1b2" * 500_000, "s", judge)) == 1


def test_cuts_stay_bounded_at_many_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILES", 2000)
    n = 10_000_000
    cuts = token_files.ranges(spark.range(n).select(F.col("id").alias("doc_id")), 1000)
    sizes = np.diff([0, *cuts, n])
    assert len(cuts) == 1999 and sizes.max() < 3 * n / 2000
    texts = token_files.ranges(spark.range(200_000).select(F.format_string("d%08d", "id").alias("doc_id")), 50)
    assert len(texts) == 1999 and texts == sorted(texts)

"""Secret scan: candidates by pattern, false positives removed by a random forest.

Patterns find strings that could be credentials: runs of 16 credential letters or more with all that dots join to them, private
key blocks, passwords in URLs, and quoted or assigned values after a telling name. A random forest, trained here from labelled findings,
then judges each by its length, its character transitions (log-odds of its pairs of characters between secrets and others, learned from
one half of the findings; the trees learn from the other), how much of it dictionary words cover (those of the license texts that come
with this package, and words that identifiers are made of), its path (the document's source), the words around it and whether it is
called or looked up. The model is a few small arrays; each task scores its candidates with it, so no text leaves its row. Candidates have
a least length (values 6, passwords in URLs 4) and no greatest.

Labelled findings: a table (before, value, after, path, secret), of which at most TRAINING rows, those with the smallest hashes, are
used. labelled() builds one from seeded random credentials and look-alikes (digests, identifiers, code, data, placeholders), as the given
tables hold none; callers may pass their own.

Defined results: null or empty text has no candidates; overlapping patterns count once: key blocks before URL passwords and named values
before runs; a probability of just the threshold (a tie) is a secret; repeated rows, with one doc_id or not, are scanned each; null doc_id
or source: like any other; very long texts are scanned whole; an empty table gives no rows; redact() keeps all columns of docs, whatever
their names, and updates n_chars if there is one.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from collections.abc import Iterable, Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that the forest is fitted on at most, its trees and their depth.
TRAINING, TREES, DEPTH = 8000, 40, 9
LEAST = 0.5
MASK = "[SECRET]"
#: Runs of credential letters; '=' only as padding, so that KEY=value is cut before its value.
LETTERS = r"A-Za-z0-9_+/\-"
RUN = rf"(?<![{LETTERS}])[{LETTERS}]{{16,}}={{0,2}}"
#: How a key block begins, how it ends, and what it is made of where no end comes before the next dashes.
PEM, PEM_END, PEM_LINES = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", r"-----END [A-Z0-9 ]*-----", r"(?:\s+[A-Za-z0-9+/=]{16,})*"
NAMED = r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assw(?:or)?d|PASSWO?R?D|[Pp]assphrase|PASSPHRASE|[Pp]wd|PWD|[Aa][Pp][Ii][_\-]?[Kk]ey|API_?KEY|[Pp]rivate[_\-]?[Kk]ey|[Aa]ccess[_\-]?[Kk]ey|ACCESS_KEY|[Cc]redential|[Aa]uth)[\"']?[ \t]*[:=]{1,2}[ \t]*[\"']?|[Bb]earer[ \t]+"
VALUE = r"[A-Za-z0-9_+/=\-.!@#$%^&*~]{6,}"
#: The password of a URL with a user.
URL = r"(?<=://)[^\s:/@\"'<>]+:(?P<password>[^\s/@\"'<>]{4,})(?=@)"
# Names that announce a credential, and words that announce a harmless look-alike.
TELLING = "token secret password passwd pwd passphrase apikey api_key key credential auth bearer private access login".split()
HARMLESS = "commit sha sha1 sha256 md5 checksum digest hash integrity sha384 sha512 base64 image uuid guid id isbn order invoice phone card number version build test example dummy sample placeholder fixture".split()
# Words that identifiers are made of.
DICTIONARY = "the and for with user name test data file path index value config service manager handler example sample default session request response client server table column string number address account message system module class function object model train batch token secret password access public private image video audio content title header footer button".split()
CLASSES = re.compile("([a-z]+)|([A-Z]+)|([0-9]+)|([^a-zA-Z0-9]+)")


class Finding(NamedTuple):
    before: str
    value: str
    after: str
    path: str


def _dotted(text: str, a: int, b: int) -> tuple[int, int]:
    """The span widened by what dots join to it, as in SG.x.y or the three parts of a JWT."""
    while m := _RIGHT.match(text, b):
        b = m.end()
    while a > 1 and text[a - 1] == "." and text[a - 2] in _LETTERS:
        a -= 2
        while a and text[a - 1] in _LETTERS:
            a -= 1
    return a, b


def finding(text: str, a: int, b: int, path: str) -> Finding:
    return Finding(text[max(0, a - 48) : a], text[a:b], text[b : b + 16], path)


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of private key blocks, however long: to the end line if that is what the next dashes begin, else over lines of its letters."""
    for m in _PEM.finditer(text):
        dashes = text.find("-----", m.end())
        end = _PEM_END.match(text, dashes) if dashes >= 0 else None
        yield m.start(), (end or _PEM_LINES.match(text, m.end())).end()


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every candidate of a text, in order, without overlaps: key blocks, then named values, then what runs have besides."""
    taken: list[tuple[int, int]] = []
    for spans in (list(key_blocks(text)), [m.span("password") for m in _URL.finditer(text)] if "://" in text else [], sorted({(m.end(), v.end()) for m in _NAMED.finditer(text) if (v := _VALUE.match(text, m.end()))})):
        kept, done, i = [], -1, 0
        for a, b in spans:
            while i < len(taken) and taken[i][1] <= a:
                i += 1
            if a >= done and not (i < len(taken) and taken[i][0] < b):
                kept.append((a, b))
                done = b
        taken = sorted(taken + kept)
    runs, done = [], -1
    for m in _RUN.finditer(text):
        if m.start() >= done:
            a, b = _dotted(text, *m.span())
            runs.append((max(a, done), b))
            done = b
    out, i = list(taken), 0
    for a, b in runs:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        k = i
        while k < len(taken) and taken[k][0] < b:
            if taken[k][0] > 0 and text[taken[k][0] - 1] not in "=:":  # else what stands before is the value's name
                out.append((a, taken[k][0]))
            a, k = max(a, taken[k][1]), k + 1
        if not (k < len(taken) and taken[k][0] == b and text[b - 1] in "=:"):
            out.append((a, b))
    rest = [(a, b) for a, b in out[len(taken) :] if b - a >= 16 and any(map(str.isalnum, text[a:b]))]
    yield from sorted(taken + rest)


_RUN, _NAMED, _VALUE, _URL, _PEM, _PEM_END, _PEM_LINES = map(re.compile, (RUN, NAMED, VALUE, URL, PEM, PEM_END, PEM_LINES))
_RIGHT = re.compile(rf"\.[{LETTERS}]+={{0,2}}")
_LETTERS = frozenset(c for c in map(chr, range(128)) if re.match(f"[{LETTERS}]", c))


def known_words(least: int = 4) -> tuple[str, ...]:
    """Distinct words of `least` letters or more of the license texts and of DICTIONARY."""
    texts = [f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return tuple(sorted({w for t in texts for w in re.findall(rf"[a-z]{{{least},}}", t.lower())} | {w for w in DICTIONARY if len(w) >= least}))


#: Classes of characters that transitions are counted between: each small and each capital letter, a digit, all else.
_KIND = np.full(256, 53, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = np.arange(26), np.arange(26, 52), 52


class Traits:
    """What findings are judged by besides themselves: log-odds of character transitions, and dictionary words."""

    def __init__(self, findings: list[tuple[Finding, bool]], words: tuple[str, ...]) -> None:
        counts = np.ones((2, 54, 54))
        for f, secret in findings:
            k = _KIND[np.frombuffer(f.value.encode("utf-8", "replace"), np.uint8)]
            np.add.at(counts[int(secret)], (k[:-1], k[1:]), 1)
        self.odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self.words, self._finder = words, None

    def __getstate__(self) -> dict:
        return {"odds": self.odds, "words": self.words, "_finder": None}

    def transitions(self, value: str) -> float:
        """Mean log-odds of the value's transitions."""
        k = _KIND[np.frombuffer(value.encode("utf-8", "replace"), np.uint8)]
        return float(self.odds[k[:-1], k[1:]].mean()) if len(k) > 1 else 0.0

    def covered(self, low: str) -> float:
        """Share of a lower-cased value that dictionary words cover."""
        if self._finder is None:
            import ahocorasick

            self._finder = ahocorasick.Automaton()
            for w in self.words:
                self._finder.add_word(w, len(w))
            self._finder.make_automaton()
        mark = np.zeros(len(low) + 1, np.int64)
        for end, n in self._finder.iter(low):
            mark[end + 1 - n] += 1
            mark[end + 1] -= 1
        return float((np.cumsum(mark[:-1]) > 0).mean()) if low else 0.0


def features(f: Finding, traits: Traits) -> list[float]:
    v, n = f.value, len(f.value)
    low = v.lower()
    parts = list(CLASSES.finditer(v))
    counts = np.unique(np.frombuffer(v.encode("utf-8", "replace"), np.uint8), return_counts=True)[1] / max(1, len(v.encode("utf-8", "replace")))
    before = re.findall(r"[A-Za-z0-9_]+", f.before.lower())[-4:]
    near = before[-1:]
    vowels = sum(c in "aeiou" for c in low)
    letters = sum(c.isalpha() for c in v)
    return [
        n,
        float(-(counts * np.log2(counts)).sum()),
        traits.transitions(v),
        (len(parts) - 1) / max(1, n - 1),  # changes between kinds of characters
        max((len(m[0]) for m in parts), default=0) / max(1, n),
        sum(c.isdigit() for c in v) / max(1, n),
        sum(c.isupper() for c in v) / max(1, n),
        float(v.isdigit()),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))),
        vowels / max(1, letters),
        traits.covered(low),
        float(any(t in w for w in near for t in TELLING)),
        float(any(t in w for w in before for t in TELLING)),
        float(any(w in HARMLESS for w in before)),
        float(bool(re.search(r"[:=][\s\"']*$", f.before))),
        float(f.before[-1:] in ("'", '"')),
        float(f.after[:1] in ("'", '"')),
        float(any(w in f.path.lower() for w in ("test", "example", "fixture", "doc"))),
        float(bool(re.fullmatch(r"(.)\1*|x+|\*+|(.{1,4})\2+", v))),
        v.count("-") / max(1, n),
        len(set(v)) / max(1, n),
        v.count(".") / max(1, n),
        float(v.startswith("-----BEGIN")),
        float(f.before[-1:] == "@"),
        max(map(len, re.findall(r"[a-z]+", v)), default=0),
        sum(map(len, re.findall(r"[A-Z]?[a-z]{2,}(?![a-z])", v))) / max(1, n),  # in words as names in code have them
        float(bool(re.search(r"://[^\s:/@]+:$", f.before)) and f.after[:1] == "@"),
        float(bool(re.match(r"[A-Za-z]{2,6}[_\-][A-Za-z0-9_\-]+$|[A-Z]{4}[A-Z0-9]{12,}$", v))),  # led by a short tag
        float(f.after[:1] in ("(", "[")),  # what is called or looked up
        float(bool(re.fullmatch(r"[A-Za-z_]+(\.[A-Za-z_]+)*\.?", v))),  # a name as code has it
        float(len(set(low))),
        float(bool(re.match(r"sha\d{1,3}-", v)) or f.before.endswith("base64,")),
    ]


def labelled(rows: int = TRAINING, seed: int = 7) -> list[tuple[Finding, bool]]:
    """Seeded labelled findings, as candidates() extracts them: half credentials in telling places or of telling form, half look-alikes."""
    r = random.Random(seed)
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["token", "secret", "password", "passphrase", "pwd", "api_key", "apikey", "access_key", "private_key", "auth_token", "client_secret", "TOKEN", "Password", "SECRET_KEY", "API_KEY", "DB_PASSWORD", "AUTH_TOKEN"]
    vocabulary, long_words, longer = known_words(3), known_words(5), known_words(6)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu ch au eu".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))

    def text(k: int) -> str:
        return " ".join(word() for _ in range(k))

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))

    def dotted() -> str:
        return r.choice([lambda: f"SG.{some(mixed, 22, 22)}.{some(mixed + '_-', 43, 43)}", lambda: f"eyJ{some(mixed, 20, 40)}.eyJ{some(mixed, 20, 200)}.{some(mixed + '_-', 43, 43)}", lambda: f"{some(mixed, 24, 24)}.{some(mixed, 6, 6)}.{some(mixed, 27, 27)}"])()

    def pem() -> str:
        kind = r.choice(["", "RSA ", "EC ", "OPENSSH "])
        body = "\n".join(some(mixed + "+/", 64, 64) for _ in range(r.randint(2, 26) if r.random() < 0.7 else r.randint(26, 500)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"

    def secret() -> tuple[str, str, str]:
        value = r.choice([lambda: some(hexes, 32, 64), lambda: some(hexes, 40, 40), lambda: some(hexes.upper(), 32, 40), lambda: some(mixed, 16, 48), lambda: some(mixed + "+/", 32, 60), lambda: r.choice(["sk_live_", "pk_test_", "ghp_", "gho_", "AIza", "npm_"]) + some(mixed, 16, 36), lambda: r.choice(["AKIA", "ASIA"]) + some(mixed[:26] + mixed[52:], 16, 16), lambda: r.choice(["xoxb", "xoxp", "xapp"]) + "-" + "-".join(some(mixed[52:], 9, 13) for _ in range(r.randint(1, 3))) + "-" + some(mixed, 18, 36), lambda: some(mixed + "!@#$%", 10, 20), dotted, lambda: some(mixed[:52], 20, 48), lambda: r.choice("-_.!").join([word(), word().capitalize() + some(mixed[52:], 1, 3), word()]), lambda: r.choice("-._~").join(some(mixed + "_~", 3, 14) for _ in range(r.randint(2, 4)))])()
        if r.random() < 0.15:
            value = r.choice([lambda: "".join(r.choice(long_words) for _ in range(r.randint(3, 5))), lambda: word() + some(mixed[52:], 1, 4), lambda: r.choice(long_words) + some(mixed[52:] + "!@#$", 1, 4)])()
        if r.random() < 0.12:
            return f"{text(3)} {r.choice(['postgres', 'mysql', 'redis', 'https', 'amqp', 'mongodb+srv'])}://{word()}:", r.choice([lambda: some(mixed, 6, 20), lambda: some(mixed + "!#$%", 8, 16), lambda: word() + some(mixed[52:], 2, 5)])(), f"@{word()}.{r.choice(['com', 'internal', 'org'])}/{word()} {text(2)}"
        if r.random() < 0.25:
            bare = r.choice([pem, dotted, lambda: some(mixed, 32, 64), lambda: some(mixed[:52], 32, 64), lambda: some(mixed + "+/", 40, 40), lambda: value if re.match("[A-Za-z]{2,5}[_-]|A[KS]IA|AIza", value) else some(mixed, 40, 44)])
            return f"{text(4)} ", bare(), f"{r.choice(['', ',', '.'])} {text(3)}"
        if r.random() < 0.08:
            return f"{text(2)} {r.choice(['Bearer', 'bearer'])} ", r.choice([dotted, lambda: some(mixed + "_-.~", 20, 60)])(), f" {text(3)}"
        quote = r.choice(['"', "'", ""])
        return f"{text(4)} {r.choice(names)}{r.choice([' = ', '=', ': ', ':', ' : ', '   :   '])}{quote}", value, f"{quote}{r.choice(['', '!!', '###', ';'])} {text(3)}"

    def other() -> tuple[str, str, str]:
        kind = r.randrange(21)
        if kind == 20:
            return f"{text(2)} {r.choice(names)}{r.choice([': ', ' = ', ':', '='])}", r.choice([lambda: r.choice(longer), word, lambda: word() + word()])(), f"{r.choice(['', ',', '.', ';'])} {text(2)}"
        if kind == 15:
            return f"{text(2)} data:{r.choice(['image', 'font', 'audio'])}/{r.choice(['png', 'jpeg', 'gif', 'woff2'])};base64,", some(mixed + "+/", 60, 900) + r.choice(["", "=", "=="]), f"{r.choice([')', chr(34), chr(39), ' '])}{text(2)}"
        if kind == 16:
            size, padding = r.choice([(43, "="), (64, ""), (86, "==")])
            return f'{text(1)} "{r.choice(["integrity", "hash", "checksum"])}": "', {43: "sha256-", 64: "sha384-", 86: "sha512-"}[size] + some(mixed + "+/", size, size) + padding, f'", {text(2)}'
        if kind in (17, 18):
            name = lambda: "_".join(r.choice([word(), r.choice(DICTIONARY)]) for _ in range(r.randint(1, 3)))
            value = ".".join(name() for _ in range(r.choice([1, 2, 2, 3])))
            return f"{text(2)} {r.choice(names)}{r.choice([' = ', '=', ': '])}", value, r.choice(["(", "[", "()", "['", '["']) + f"{text(1)})" if "." not in value or r.random() < 0.7 else f"{r.choice([',', ')', ';', chr(10)])} {text(2)}"
        if kind == 19:
            letters = r.choice(["ACGT", "acgt", "ACGU", "01", "ab", some(mixed, 3, 5)])
            return f"{text(3)} ", some(letters, 20, 400), f" {text(2)}"
        if kind == 0:
            return f"{text(3)} {r.choice(HARMLESS)}{r.choice([' ', ': ', '='])}", some(hexes, 32, 64), f" {text(3)}"
        if kind == 1:
            return f"{text(4)} ", some("0123456789", 13, 20), f" {text(3)}"
        if kind == 2:
            return f"{text(3)} ", "-".join(some(hexes, k, k) for k in (8, 4, 4, 4, 12)), f" {text(3)}"
        if kind == 3:
            return f"{text(3)} ", "_".join(r.choice(DICTIONARY) for _ in range(4)) + some("0123456789", 1, 3), f" {text(2)}"
        if kind == 4:
            return f"{text(2)} {r.choice(names)}{r.choice([' = ', ': '])}\"", r.choice(["x" * 16, "changeme1", "your_token_here", "0" * 20, "password123", "example-token-1", "abcabcabcabc", "<redacted>..."]), f'" {text(2)}'
        if kind == 5:
            return f"{text(3)} ", word() + word() + some("0123456789", 1, 4) + word() + word(), f" {text(3)}"
        if kind == 6:
            return f"{text(2)} {r.choice(names)}: ", word() + word() + word(), f" {text(2)}"
        if kind == 7:
            return f"{text(3)} ", r.choice([str.lower, str.capitalize, str.upper])("".join(word() for _ in range(6))), f"{r.choice(['', ',', '.'])} {text(3)}"
        if kind == 8:
            return f"{text(3)} ", "".join(r.choice(vocabulary).capitalize() for _ in range(r.randint(3, 8))), f" {text(3)}"
        if kind == 9:
            return f"{text(2)} ", ".".join([r.choice(["www", "com", "org", word()]), "".join(word() for _ in range(5)), r.choice([*DICTIONARY, "com"]), r.choice(["example", "org", word()])]), f" {text(2)}"
        if kind == 10:
            return f"{text(2)} {word()}@", "-".join([word() + word(), word() + word(), word()]) + ".example.com", f" {text(2)}"
        if kind == 12:
            return f"{text(3)} ", "".join(word().capitalize() for _ in range(r.randint(4, 7))), f" {text(3)}"
        if kind == 13:
            return f"{text(2)} {r.choice(['Bearer', 'bearer'])} ", word() + word() + word(), f" {text(2)}"
        if kind == 11:
            return f"{text(2)} ", r.choice(["-", "_", "/"]).join(word() for _ in range(r.randint(3, 7))), f" {text(2)}"
        return f"{text(3)} see ", "/".join(["a" + word(), word(), word() + some("0123456789", 1, 2), "index"]), f" {text(3)}"

    out: list[tuple[Finding, bool]] = []
    while len(out) < rows:
        wanted = bool(len(out) % 2)
        before, value, after = secret() if wanted else other()
        path, whole = f"src{r.randrange(40)}" if r.random() < 0.9 else "tests/data", before + value + after
        out += [(finding(whole, a, b, path), wanted) for a, b in candidates(whole) if a < len(before) + len(value) and b > len(before)][:1]
    return out


class Forest:
    """A random forest over binary labels: bootstrap rows, a random third of the features at each split, Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            size = 2 ** (depth + 1) - 1
            tree = (np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size))
            self._grow(tree, 0, 0, x[rows], y[rows].astype(float), rng)
            self.trees.append(tree)

    def _grow(self, tree: tuple, node: int, level: int, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        feature, cut, value = tree
        value[node] = y.mean() if len(y) else value[(node - 1) // 2]
        best = (np.inf, 0, np.inf)
        if level < self.depth and len(y) >= 8 and 0 < value[node] < 1:
            for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                xs, ys = x[order, f], np.cumsum(y[order])
                at = np.flatnonzero(xs[1:] > xs[:-1]) + 1
                if len(at):
                    left, right = ys[at - 1], ys[-1] - ys[at - 1]
                    n, m = at, len(y) - at
                    cost = left * (1 - left / n) + right * (1 - right / m)
                    k = int(cost.argmin())
                    best = min(best, (float(cost[k]), int(f), float((xs[at[k] - 1] + xs[at[k]]) / 2)))
        if best[0] < np.inf:
            feature[node], cut[node] = best[1:]
            left = x[:, best[1]] <= best[2]
            self._grow(tree, 2 * node + 1, level + 1, x[left], y[left], rng)
            self._grow(tree, 2 * node + 2, level + 1, x[~left], y[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of trees' leaf means; one row of x per candidate."""
        total = np.zeros(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = cut[at] < np.inf
                at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at]), at)
            total += value[at]
        return total / len(self.trees)


class Judge:
    """A forest and the traits that its features need."""

    def __init__(self, findings: Iterable[tuple[Finding, bool]], most: int = TRAINING) -> None:
        place = lambda x: hashlib.sha256("\x00".join(x[0]).encode("utf-8", "replace")).digest()
        found = heapq.nsmallest(most, findings, place)
        self.traits = Traits(found[::2], known_words())
        rows = found[1::2]
        self.forest = Forest(self.features([f for f, _ in rows]), np.array([s for _, s in rows]))

    def features(self, findings: list[Finding]) -> np.ndarray:
        return np.array([features(f, self.traits) for f in findings])

    def score(self, findings: list[Finding]) -> np.ndarray:
        """Probability of being a secret."""
        return self.forest.score(self.features(findings)) if findings else np.empty(0)


def train(findings: DataFrame) -> Judge:
    """A judge from a table of labelled findings (before, value, after, path, secret); at most TRAINING rows reach the driver."""
    columns = ["before", "value", "after", "path"]
    known = findings.where("length(value) > 0 AND secret IS NOT NULL").select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("secret").cast("boolean").alias("secret"))
    rows = known.orderBy(F.xxhash64(*columns)).limit(TRAINING).collect()
    return Judge((Finding(*r[:4]), r["secret"]) for r in rows)


_JUDGE: list[Judge] = []


def trained() -> Judge:
    """The judge from labelled(), fitted once for each process."""
    if not _JUDGE:
        _JUDGE.append(Judge(labelled()))
    return _JUDGE[0]


def found_in(text: str, path: str, judge: Judge) -> list[tuple[int, int, float]]:
    """(start, end, probability) of every candidate of a text."""
    spans = list(candidates(text))
    scores = judge.score([finding(text, a, b, path) for a, b in spans])
    return [(a, b, float(p)) for (a, b), p in zip(spans, scores)]


#: A row can have candidates only if this matches; Java's regex, before any text goes to Python.
POSSIBLE = f"[{LETTERS}]{{16}}|{NAMED}|-----BEGIN |://[^\\s:/@]+:[^\\s/@]{{4,}}@"


def scan(docs: DataFrame, judge: Judge | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, start, length, probability, is_secret and value_sha256 (values stay out of reports) of every candidate."""
    judge = judge or trained()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for i, (text, path) in enumerate(zip(b.column(1), b.column(2))):
                t = text.as_py()
                rows += [(i, s, e - s, p, p >= least, hashlib.sha256(t[s:e].encode("utf-8", "surrogatepass")).hexdigest()) for s, e, p in found_in(t, path.as_py() or "", judge)]
            if rows:
                who, start, length, p, is_secret, digest = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(p), pa.array(is_secret), pa.array(digest)], ["doc_id", "start", "length", "probability", "is_secret", "value_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    possible = docs.select("doc_id", "text", F.col("source").cast("string").alias("source")).where(F.col("text").rlike(POSSIBLE))
    return possible.mapInArrow(batches, f"doc_id {kind}, start bigint, length bigint, probability double, is_secret boolean, value_sha256 string")


def redact(docs: DataFrame, judge: Judge | None = None, least: float = LEAST, mask: str = MASK) -> DataFrame:
    """docs with every secret in text replaced by mask."""
    judge = judge or trained()

    @F.pandas_udf("string")
    def masked(text, path):  # noqa: ANN001, ANN202
        def one(t: str | None, p: str | None) -> str | None:
            parts, at = [], 0
            for s, e, chance in found_in(t or "", p or "", judge):
                if chance >= least:
                    parts += [t[at:s], mask]
                    at = e
            return "".join([*parts, t[at:]]) if at else t

        return type(text)([one(t, p) for t, p in zip(text, path)], dtype=object)

    possible = F.when(F.col("text").rlike(POSSIBLE), F.col("text"))  # all other rows go to Python as nulls
    text = F.coalesce(masked(possible, F.col("source").cast("string")), F.col("text"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), text.alias("masked"))
    columns = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("masked").eqNullSafe(F.col("doc.text")), F.col("doc.n_chars")).otherwise(F.length("masked")).cast(docs.schema["n_chars"].dataType)
    return own.select(*(columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

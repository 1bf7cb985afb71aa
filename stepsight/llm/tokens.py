"""Whole texts to token ids, an Arrow array at a time, with a bounded cache of words.

Both tokenizers split a text into words before they merge, so a text's ids are its words' ids put together. Arrow cuts an
array of texts into words and numbers the distinct ones; only words that the worker has not met go to the tokenizer, many
at a time; numpy puts the ids together again.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: New words that one worker's cache takes in (about 200 bytes each) before it keeps only those met again since it last did so.
CACHE = 600_000
#: Bytes of text that are cut into words at a time.
BATCH_BYTES = 3_000_000
#: Unicode white space, for RE2.
BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word of Latin letters, then signs: the tokenizers cut it between the two, and only lower-casing (if any) applies.
LATIN = re.compile(r"( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    """Gives the same ids as the tokenizer's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Finds the texts with an added token, which the tokenizer cuts out before it looks for words.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added, self.any_case = "|".join(re.escape(t.content) for t in added), any(t.normalized for t in added)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.keeps_blanks = bool(self._plain([" "])[0])
        self.mark = "\n" if self.keeps_blanks else " \x1e "
        self.marks = self._plain([self.mark])[0]
        self.lower = self._plain(["A"]) == self._plain(["a"])
        #: What stands for a character in the merge table, as the tokenizer itself shows it.
        self.table = {c: self._shown(chr(c)) for c in (32, *range(33, 127), *range(192, 256))}
        self.cache: dict[str, bytes] = {}
        self.again: dict[str, bytes] = {}

    def _shown(self, text: str) -> str:
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def _latin(self, body: str) -> bytes | None:
        """Ids of a word that LATIN matches, straight from the merges; None for others."""
        if not (m := LATIN(body)):
            return None
        blank, letters, signs = m.groups()
        merge = self.tokenizer.model.tokenize
        tokens = merge((blank + (letters.lower() if self.lower else letters)).translate(self.table))
        if signs:
            tokens += merge(signs)
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Encodes words: those of ASCII letters by the merges at once; of others those that LATIN matches by the merges, and the rest in
        runs with a mark between; where the marks can't be told, one by one."""
        merge, code, cache = self.tokenizer.model.tokenize, self.code, self.cache
        lead = self.table[32] if self.keeps_blanks else ""
        rest = []
        for w in new:
            if w.isascii() and w.isalpha():
                cache[w] = array(code, [t.id for t in merge(lead + (w.lower() if self.lower else w))]).tobytes()
            else:
                rest.append(w)
        bodies = [self._body(w) for w in rest]
        found = {i: ids for i, x in enumerate(bodies) if (ids := self._latin(x)) is not None}
        even = [i for i, x in enumerate(bodies) if i not in found and "\x1e" not in x]
        runs = [even[i : i + 2000] for i in range(0, len(even), 2000)]
        size = self.kind.itemsize
        for run, ids in zip(runs, self._plain([self.mark.join(bodies[i] for i in r) for r in runs])):
            ids = np.array(ids, self.kind)
            at = np.flatnonzero(ids == self.marks[0]).tolist()
            if len(self.marks) == 1 and len(at) == len(run) - 1:
                data = ids.tobytes()
                found.update((i, data[a * size : b * size]) for i, a, b in zip(run, [0, *(x + 1 for x in at)], [*at, len(ids)]))
        odd = [i for i in range(len(rest)) if i not in found]
        found.update((i, np.array(ids, self.kind).tobytes()) for i, ids in zip(odd, self._plain([bodies[i] for i in odd])))
        line_end = np.array(self.marks, self.kind).tobytes()
        cache.update((w, line_end + found[i] if self.keeps_blanks and w[:1] == "\n" else found[i]) for i, w in enumerate(rest))

    def _body(self, word: str) -> str:
        """What to encode for a word: where blanks count, one follows a blank unless it starts a text or a line."""
        if not self.keeps_blanks:
            return word
        return word[1:] if word[:1] in ("\n", "\x00") else " " + word

    def _words(self, texts: pa.Array) -> pa.ListArray:
        """Words of each text, such that the tokenizer ends a word wherever one is cut off. Where blanks count, a word that starts a
        line keeps the line end, a word that starts a text gets \\x00, and every other has lost the one blank before it."""
        if not self.keeps_blanks:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        start = pa.scalar("\x00", pa.large_string())
        return pc.split_pattern(pc.binary_join_element_wise(start, pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string())), " ")

    def _simple(self, texts: pa.Array) -> np.ndarray:
        """Which texts _words can cut: those without added tokens; where blanks count, whose blanks stand alone and between other characters."""
        plain = ~pc.match_substring_regex(texts, self.added, ignore_case=self.any_case).to_numpy(zero_copy_only=False) if self.added else np.ones(len(texts), bool)
        if not self.keeps_blanks:
            return plain
        return plain & ~pc.match_substring_regex(texts, f"{BLANK}{BLANK}|^{BLANK}|{BLANK}$|^$|\x00").to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of successive slices of an Arrow array of texts; text i of a slice has ids[offsets[i]:offsets[i + 1]]. Null: none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield self._slice(pc.fill_null(texts.slice(at, to - at).cast(pa.large_string()), ""))
            at = to

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = self._simple(texts)
        if not simple.all():  # few: the tokenizer takes them whole
            whole = [np.array(x, self.kind) for x in self._plain(texts.filter(pa.array(~simple)).to_pylist())]
            ids, offsets = self._slice(texts.filter(pa.array(simple)))
            parts, rest = iter(np.split(ids, offsets[1:-1]) if len(offsets) > 1 else []), iter(whole)
            parts = [next(parts) if s else next(rest) for s in simple]
            return np.concatenate([np.empty(0, self.kind), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        if not len(texts):
            return np.empty(0, self.kind), np.zeros(1, np.int64)
        cut = self._words(texts)
        coded = cut.flatten().dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        parts = list(map(self.cache.get, known))
        if new := [w for w, x in zip(known, parts) if x is None]:
            self.again.update((w, x) for w, x in zip(known, parts) if x is not None)
            if len(self.cache) > CACHE:
                self.cache, self.again = self.again, {}
            self._learn(new)
            parts = [self.cache[w] for w in known]
        flat = np.frombuffer(b"".join(parts), self.kind)
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        codes = coded.indices.to_numpy(zero_copy_only=False)
        size = n[codes]
        out = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(out[-1]) + np.repeat((np.cumsum(n) - n)[codes] - out[:-1], size)]
        return ids, out[cut.offsets.to_numpy() - cut.offsets[0].as_py()]


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

"""Numpy part of the suffix-array dedup: sampled suffixes of a text and names of its substrings.

From every run of MATCH bytes one suffix is sampled: the start of the run's smallest GRAM-byte string (the last one of equal
ones). Equal runs sample the same suffix at the same place, so long matches are found among sampled suffixes alone.
"""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

MATCH = 400
GRAM = 32
#: A run of MATCH bytes has SIDE bytes or more before its sampled gram, or more than that after it.
SIDE = (MATCH - GRAM) // 2
#: How far the prefixes of a suffix that get names go beyond its gram.
PREFIXES = (SIDE // 2, SIDE)
#: Bytes that are looked at together; positions within fit the low bits of a sort key.
BLOCK = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64(BLOCK - 1)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes; powers of the multiplier and of its inverse modulo 2^64."""
    n = BLOCK + 1
    up, down = (np.cumprod(np.array([1, *[m] * (n - 1)], np.uint64), dtype=np.uint64) for m in (MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64)))
    return np.random.default_rng(5).integers(0, 2**64, 256, np.uint64), up, down


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = x + np.asarray(salt, np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Block:
    """Hashes of the substrings of up to BLOCK bytes."""

    def __init__(self, data: np.ndarray) -> None:
        value, up, self.down = _tables()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, length: np.ndarray | int, salt: int) -> np.ndarray:
        """A 64-bit number for each substring at[i]:at[i] + length[i], as signed numbers."""
        return _mix((self.sums[at + length] - self.sums[at]) * self.down[at], np.asarray(length, np.uint64) + np.uint64(salt << 32)).view(np.int64)


class Segments(NamedTuple):
    """Runs of MATCH bytes that start one after another and have the same sampled suffix."""

    low: np.ndarray  # start of the first run
    n: np.ndarray  # how many runs
    at: np.ndarray  # where the sampled suffix starts


def segments(data: np.ndarray, block: Block) -> Segments:
    """Segments of up to BLOCK bytes."""
    runs = len(data) - MATCH + 1
    if runs <= 0:
        return Segments(*(np.empty(0, np.int64),) * 3)
    grams = np.arange(len(data) - GRAM + 1)
    key = (_mix((block.sums[GRAM:] - block.sums[: -GRAM]) * block.down[: len(grams)], 1) & ~_LOW) | (_LOW - grams.astype(np.uint64))
    width, span = MATCH - GRAM + 1, 1
    while span * 2 <= width:
        key, span = np.minimum(key[:-span], key[span:]), span * 2
    key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    at = (_LOW - (key & _LOW)).astype(np.int64)
    low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return Segments(low, np.diff(np.append(low, runs)), at[low])


def blocks(size: int):
    """(from, to) of the blocks of a text of so many bytes; each run of MATCH bytes lies in exactly one as a start."""
    step = BLOCK - MATCH + 1
    for a in range(0, max(size - MATCH + 1, 0), step):
        yield a, min(size, a + BLOCK)

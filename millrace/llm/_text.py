"""Vectorised text primitives: code points, words and shingles as hash arrays.

Texts of any length are walked in blocks, so memory stays bounded by the block
and by the result, and every text is processed whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_NON_WORD = re.compile(r"\W|_")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every input bit matters."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def char_table(kind: str) -> np.ndarray:
    """For every code point whether it is a letter or digit (``word``) or a letter (``letter``)."""
    test = str.isalnum if kind == "word" else str.isalpha
    return np.fromiter((test(chr(i)) for i in range(0x110000)), dtype=bool, count=0x110000)


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        one = np.ones(1, dtype=np.uint64)
        up = np.cumprod(np.concatenate((one, np.full(2 * BLOCK, _BASE, dtype=np.uint64))), dtype=np.uint64)
        down = np.cumprod(np.concatenate((one, np.full(2 * BLOCK, pow(_BASE, -1, 1 << 64), dtype=np.uint64))), dtype=np.uint64)
    return up, down


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def blocks(text: str) -> Iterator[str]:
    """Pieces of about BLOCK characters that end between words; a word longer than a block is cut."""
    at = 0
    while len(text) - at > BLOCK:
        cut = _NON_WORD.search(text, at + BLOCK, at + 2 * BLOCK - 1)
        end = cut.start() if cut else at + 2 * BLOCK - 1
        yield text[at:end]
        at = end
    yield text[at:]


def _word_sums(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block the running polynomial sums and the starts and ends of its words."""
    up, _ = _powers()
    table = char_table("word")
    for piece in blocks(text.lower()):
        points = code_points(piece)
        starts, ends = runs(table[points])
        if len(starts):
            total = np.zeros(len(points) + 1, dtype=np.uint64)
            np.cumsum((points + np.uint32(1)).astype(np.uint64) * up[: len(points)], out=total[1:])
            yield total, starts, ends


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word (run of letters and digits, lower case), in order; none for null or empty."""
    down = _powers()[1]
    out = [mixed((total[ends] - total[starts]) * down[starts]) for total, starts, ends in _word_sums(text or "")]
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def word_heads(text: str | None, lengths: range) -> np.ndarray:
    """The set of hashes of the words' first characters, for each length in ``lengths`` that is shorter than the word."""
    down, out = _powers()[1], []
    for total, starts, ends in _word_sums(text or ""):
        for n in lengths:
            at = starts[ends - starts > n]
            out.append(np.unique(mixed((total[at + n] - total[at]) * down[at] + np.uint64(n))))
    return np.unique(np.concatenate(out)) if out else np.empty(0, dtype=np.uint64)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The sorted set of hashes of k consecutive words; a shorter text has one shingle of all its words."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    last = len(words) - k + 1
    value = np.full(last, k, dtype=np.uint64)
    for j in range(k):
        value = value * np.uint64(0xA0761D6478BD642F) + words[j : last + j]
    return np.unique(mixed(value))

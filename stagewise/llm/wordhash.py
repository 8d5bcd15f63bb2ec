"""Hashes of words and of runs of words for whole Arrow batches, with numpy.

A word is a run of characters other than the six ASCII blanks, as in shared.WORD. Since blanks are single
bytes in UTF-8, words are cut from the bytes of the batch; a word's hash is that of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Terms(NamedTuple):
    """Hashes one text after another; text i has hashes[starts[i]:starts[i + 1]]."""

    hashes: np.ndarray
    starts: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each number over the whole number (the finalizer of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts); null: empty."""
    arr = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    _, at, data = arr.buffers()
    starts = np.frombuffer(at, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def pieces(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Runs of whole texts of about so many bytes together, with the number of the first; a longer text comes alone."""
    _, starts = utf8(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + size, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def word_hashes(texts: pa.Array) -> Terms:
    data, at = utf8(texts)
    if not len(data):
        return Terms(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # no word runs from one text into the next
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    begin = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:]))
    up, down = powers(1 << max(20, int(len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mix((sums[end + 1] - sums[begin]) * down[begin])
    return Terms(h, np.searchsorted(begin, at).astype(np.int64))


def shingles(words: Terms, k: int) -> Terms:
    """Hashes of all runs of k words; a text of fewer words, but one at least, has one run of all of them."""
    h, at = words
    n = np.diff(at)
    if k == 1 or not len(h):
        return words
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.zeros(len(at), np.int64)
    np.cumsum(count, out=starts[1:])
    first = np.arange(starts[-1]) - np.repeat(starts[:-1], count) + np.repeat(at[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = np.zeros(len(first), np.uint64)
    for j in range(k):
        word = h[np.minimum(first + j, len(h) - 1)]
        out = np.where(j < length, mix(out * np.uint64(BASE) + word), out)
    return Terms(out, starts)

"""Word shingles of texts as 64-bit hashes, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n + (n >> 3), _BASE, np.uint64), dtype=np.uint64)])
    return _POWERS[:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words between ASCII white space, and how many each text has."""
    texts = pc.utf8_lower(pa.concat_arrays([texts.cast(pa.large_string())]))
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    opens[first] = inside[first]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    ends = np.flatnonzero(closes) + 1
    powers = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
        # brought to one power: the sum of a word times base ** (the batch's length - the word's start)
        words = mix((sums[ends] - sums[starts]) * powers[len(data) - starts] * _inverse_shift(len(data)))
    return words, np.diff(np.searchsorted(starts, edges)).astype(np.int64)


def _inverse_shift(n: int) -> np.uint64:
    """base ** -n modulo 2 ** 64, so that hashes don't depend on the batch."""
    return np.uint64(pow(pow(int(_BASE), -1, 1 << 64), n, 1 << 64))


def shingle_hashes(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words, and how many each text has.

    A text of fewer words, but at least one, has one shingle of all its words; an empty one none.
    """
    words, lens = word_hashes(texts)
    with np.errstate(over="ignore"):
        odd = [np.uint64(pow(0xD6E8FEB86659FD93, 2 * k + 1, 1 << 64)) for k in range(width)]
        total = max(len(words) - width + 1, 0)
        rolled = np.zeros(len(words), np.uint64)
        for k in range(width):
            rolled[:total] += words[k : total + k] * odd[k]
        starts = np.cumsum(lens) - lens
        short = np.flatnonzero((lens > 0) & (lens < width))
        for i in short:
            a = starts[i]
            rolled[a] = sum(int(words[a + k]) * int(odd[k]) for k in range(lens[i])) % (1 << 64)
    n = np.where(lens >= width, lens - width + 1, np.minimum(lens, 1))
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return mix(rolled[at]), n

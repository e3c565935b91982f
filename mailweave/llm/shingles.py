"""Word shingles of whole Arrow batches as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(1 << 12, STEP, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(upto: int) -> np.ndarray:
    global _powers
    if upto > len(_powers):
        _powers = np.cumprod(np.full(upto, STEP, dtype=np.uint64))
    return _powers


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the blank-separated words of a string column, A-Z lower-cased, and the row each word stands in."""
    texts = pa.concat_arrays([texts.fill_null("")]) if texts.null_count or texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[:len(texts) + 1].astype(np.int64)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    if not len(texts) or offsets[-1] == offsets[0]:
        return none
    data = LOWER[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = ~BLANK[data]
    fresh = np.empty(len(data), dtype=bool)
    fresh[0] = True
    fresh[1:] = ~inside[:-1]
    fresh[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text ends the word of the text before
    starts = np.flatnonzero(inside & fresh)
    if not len(starts):
        return none
    at = np.flatnonzero(inside)
    word = np.cumsum((inside & fresh)[at]) - 1
    place = at - starts[word]
    sums = np.add.reduceat(BYTE[data[at]] * _power(int(place.max()) + 1)[place], np.searchsorted(at, starts))
    return mix(sums), np.searchsorted(offsets, starts, side="right") - 1


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in text order, and where each row's run of them starts (rows + 1 values).

    A row of fewer than ``k`` words has its whole sequence as its only shingle; a row without words has none.
    """
    n = len(texts)
    hashed, row = words(texts)
    if not len(hashed):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    count = np.bincount(row, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    factors = _power(k + 1)
    made = np.zeros(len(hashed), dtype=np.uint64)
    for j in range(min(k, int(count.max()))):
        reach = len(hashed) - j
        part = hashed[j:] * factors[j]
        part[row[j:] != row[:reach]] = 0
        made[:reach] += part
    keep = np.arange(len(hashed)) - first[row] <= np.maximum(count - k, 0)[row]
    short = count[row] < k
    made[short] += count[row[short]].astype(np.uint64) * factors[k]
    return mix(made[keep]), np.r_[0, np.cumsum(np.where(count == 0, 0, np.maximum(count - k + 1, 1)))]

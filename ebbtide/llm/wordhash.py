"""Hashes of the words of many texts at once, straight from Arrow's text buffers.

A word's hash is a polynomial over random 64-bit values of its bytes, modulo 2^64, taken from prefix
sums of a whole block of texts, then mixed; no word becomes a Python object. Words are runs of bytes
other than x20 and x09-x0D; A-Z count as a-z. Blocks end at separators, so that memory stays bounded
for texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
MULTIPLIER = 0x9E3779B97F4A7C13  # 3 modulo 4
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
VALUE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
EXACT = VALUE.copy()
VALUE[65:91] = VALUE[97:123]


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


POWER, UNPOWER = powers(MULTIPLIER, BLOCK + 1), powers(INVERSE, BLOCK + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _block(data: np.ndarray, cuts: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of each word of a block; no word crosses one of the places in `cuts`."""
    global POWER, UNPOWER
    if len(data) >= len(POWER):
        # One word longer than a block.
        POWER, UNPOWER = powers(MULTIPLIER, len(data) + 1), powers(INVERSE, len(data) + 1)
    inside = ~SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = np.empty(len(data), bool)
    last[:-1] = ~inside[1:] | first[1:]
    last[-1] = True
    last &= inside
    ends = np.flatnonzero(last)
    sums = np.cumsum(value[data] * POWER[: len(data)])
    h = sums[ends]
    before = starts > 0
    h[before] -= sums[starts[before] - 1]
    return mixed(h * UNPOWER[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text); a null text has none."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    if hi == lo:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi]
    bounds = offsets - lo
    value = VALUE if lower else EXACT
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            # The last place at or before `end` where no word goes on: a text's end or a separator.
            edge = int(bounds[np.searchsorted(bounds, end, "right") - 1])
            seps = np.flatnonzero(SEPARATOR[data[max(at, end - 4096) : end]])
            gap = max(at, end - 4096) + int(seps[-1]) + 1 if len(seps) else at
            if max(edge, gap) > at:
                end = max(edge, gap)
                break
            end = min(len(data), end + 4096)
        i, j = np.searchsorted(bounds, [at, end], "left")
        h, s = _block(data[at:end], bounds[i:j] - at, value)
        hashes.append(h)
        places.append(s + at)
        at = end
    h, s = np.concatenate(hashes), np.concatenate(places)
    return h, np.diff(np.searchsorted(s, bounds, "left"))

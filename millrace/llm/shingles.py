"""Word shingles of many texts at once, as 64-bit numbers, in NumPy.

A word is a run of bytes that are not ASCII white space. Words hash by a
polynomial over their bytes, shingles by a linear combination of mixed word
hashes that is mixed again.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes that are hashed at a time; a longer word is a block of its own.
BLOCK = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers at least; those of more than a block are not kept."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    size = max(n + 1, BLOCK + 2)
    made = []
    for base in (BASE, INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if size == BLOCK + 2:
        _powers[:] = made
    return made[0], made[1]


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which is faster than np.unique on these."""
    out = np.sort(values)
    if len(out) < 2:
        return out
    new = np.empty(len(out), bool)
    new[0] = True
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


def spans(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows end to end, runs of `solid`: their starts, ends, and each row's first run (one entry more than rows)."""
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(solid))]
    begins[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`spans` of the bytes that are not ASCII white space."""
    return spans(~SPACE[data], offsets)


def hash_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span, ascending and apart; the same wherever the span stands."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        sums = hash_sums(data[base : int(ends[stop - 1])])
        out[k:stop] = span_hashes(sums, starts[k:stop] - base, ends[k:stop] - base)
        k = stop
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct shingles of `width` lower-cased words.

    Fewer words make one shingle of the whole sequence; no word, none.
    """
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - width + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(width):
        whole += words[k : k + n] * factors[k]
    whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(distinct(whole[a : b - width + 1]))
        elif b > a:
            out.append(mix64((words[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

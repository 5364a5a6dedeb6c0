"""64-bit hashes of words and of runs of words, for many texts at once in numpy.

A word is a run of bytes other than space and 0x09 to 0x0D, with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


OF_BYTE = mix((LOWER.astype(np.uint64) + np.uint64(1)) * FACTOR)


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word of the texts, and the offsets of each text's words."""
    inside = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(flat) else inside
    after = np.concatenate([inside[1:], [False]]) if len(flat) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lengths = ends - starts
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, at
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), FACTOR)]))
    letters = flat[inside]
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sums = np.add.reduceat(OF_BYTE[letters] * powers[place], np.cumsum(lengths) - lengths)
    return mix(sums + lengths.astype(np.uint64) * FACTOR), starts, ends, at


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words; run i starts at word i."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - length + 1, np.uint64(length))
    for k in range(length):
        total = total * FACTOR + hashes[k : len(hashes) - length + 1 + k]
    return mix(total)


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word shingles; of a shorter text, its whole sequence as one."""
    hashes, _, _, at = words(flat, offsets)
    every, out = runs(hashes, width), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(every[a : b - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out

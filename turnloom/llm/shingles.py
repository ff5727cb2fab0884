"""Word shingles of whole texts as 64-bit hashes, for many rows at once."""

from __future__ import annotations

import numpy as np

from turnloom.llm.arrow import mixed

_RANDOM = np.random.default_rng(20240229)
_STEP = np.uint64(_RANDOM.integers(1 << 62, 1 << 63, dtype=np.uint64) * 2 + 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number per byte, letters A-Z like a-z, white space zero.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words per row. Words are runs of bytes other than ASCII white space."""
    base = int(offsets[0])
    data, offsets = data[base : int(offsets[-1])], offsets - base
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    ahead, back = _power_tables(len(data))
    sums = np.add.reduceat(_BYTE[data] * ahead[: len(data)], starts)
    return mixed(sums * back[starts]), counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and row offsets into them.

    A row with fewer than ``width`` words has its whole word sequence as one shingle; a row without words has none.
    """
    words, counts = word_hashes(data, offsets)
    ends = np.cumsum(counts)
    starts = ends - counts
    hashes = words * np.uint64(0x9E3779B97F4A7C15) + np.uint64(width)
    for step in range(1, width):
        hashes = mixed(hashes[: len(words) - step]) * np.uint64(0x9E3779B97F4A7C15) + words[step:] if len(words) > step else hashes[:0]
    hashes = mixed(hashes)
    out, sizes = [], np.zeros(len(counts), np.int64)
    for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        if b - a >= width:
            own = np.sort(hashes[a : b - width + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            value = b - a
            for w in words[a:b].tolist():
                value = int(mixed(np.array([(value * 31 + w) & (1 << 64) - 1], np.uint64))[0])
            own = np.array([value], np.uint64)
        else:
            continue
        out.append(own)
        sizes[row] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))

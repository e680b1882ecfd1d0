"""Word hashes of Arrow text columns with a choice of separators and case, long texts block by block."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .shingles import chunks, mix, powers, text_buffer

#: Text bytes hashed at once; a single word beyond it is hashed by a digest of its own.
BLOCK = 1 << 20
_VALUES = np.random.default_rng(20_160_404).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def in_words(separators: str) -> np.ndarray:
    """A table of the bytes that belong to words: all but the ASCII ``separators``."""
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


def byte_values(*, fold: bool) -> np.ndarray:
    """The hash values of bytes; with ``fold`` A-Z count as a-z."""
    out = _VALUES.copy()
    if fold:
        out[65:91] = out[97:123]
    return out


@dataclass(frozen=True)
class Words:
    """Words of the texts of rows ``first`` to ``last`` (exclusive): hashes, where each lies in ``data``, and per row where its words begin."""

    first: int
    last: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _edges(data: np.ndarray, inside_table: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = inside_table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def _long(data: np.ndarray, inside_table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of one long text, block by block; blocks end at separators."""
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):
            gap = np.flatnonzero(~inside_table[data[end:end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(len(data), end + BLOCK)
            if len(gap):
                break
        block = data[at:end]
        s, e = _edges(block, inside_table, np.array([0, len(block)]))
        big = e - s > BLOCK
        if big.any():
            lone = np.array([int.from_bytes(hashlib.blake2b(_folded(block[a:b], values), digest_size=8).digest(), "little") for a, b in zip(s[big], e[big])], np.uint64)
            h = np.zeros(len(s), np.uint64)
            h[big] = lone
            for k in np.flatnonzero(~big):  # few: such a block is mostly one word
                h[k] = _hashed(block[s[k]:e[k]], np.array([0]), np.array([e[k] - s[k]]), values)[0]
        else:
            h = _hashed(block, s, e, values)
        found.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def _folded(word: np.ndarray, values: np.ndarray) -> bytes:
    if values[65] != values[97]:
        return word.tobytes()
    return np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8).tobytes()


def words_of(column: pa.Array, inside_table: np.ndarray, values: np.ndarray) -> Iterator[Words]:
    """The words of a column's texts, some texts at a time (a long text alone); a null has none."""
    data, offsets = text_buffer(column)
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part, bounds = data[lo:hi], offsets[a:b + 1] - lo
        if hi - lo <= 2 * BLOCK or b - a > 1:
            starts, ends = _edges(part, inside_table, bounds)
            hashes = _hashed(part, starts, ends, values)
        else:
            hashes, starts, ends = _long(part, inside_table, values)
        yield Words(a, b, part, hashes, starts, ends, np.searchsorted(starts, bounds))


def folds(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``fold`` takes the digest of any run of words."""
    up, _ = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:len(hashes)], out=total[1:])
    return total


def fold(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the runs of words from ``start`` to ``end``."""
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))

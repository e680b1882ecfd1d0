"""Word and shingle hashes of Arrow text columns, vectorised over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WIDTH = 5
#: Text bytes hashed at once (a single longer text is hashed whole).
CHUNK = 1 << 18

_rng = np.random.default_rng(20_010_911)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE, _STEP, _TAG = (int(x) * 2 + 1 for x in _rng.integers(1, 1 << 62, 3))
_INVERSE = pow(_BASE, -1, 1 << 64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_into(h: np.ndarray, spare: np.ndarray) -> None:
    """``mix`` in place; ``spare`` is a buffer of the same size."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(h, np.uint64(shift), out=spare)
        h ^= spare
        if factor:
            h *= np.uint64(factor)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    if column.type != pa.string():
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes, one row at least."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie end to end, and per text where its words begin."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text its distinct shingle hashes, ascending; a text of fewer words than WIDTH is one shingle."""
    data, offsets = text_buffer(column)
    step = np.uint64(_STEP)
    for a, b in chunks(offsets):
        words, at = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        n = len(words) - WIDTH + 1
        rolled = words[:max(n, 0)].copy()
        for k in range(1, WIDTH):
            rolled = rolled * step + words[k:k + max(n, 0)]
        rolled = mix(rolled)
        for s, e in zip(at.tolist(), at[1:].tolist()):
            if e - s >= WIDTH:
                yield np.unique(rolled[s:e - WIDTH + 1])
            elif e > s:
                h = 0
                for w in words[s:e].tolist():
                    h = (h * _STEP + w) % (1 << 64)
                yield mix(np.array([(h + (e - s) * _TAG) % (1 << 64)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

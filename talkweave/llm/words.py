"""Words and word hashes of whole columns of text, computed on the bytes of an Arrow column.

A word is a run of bytes other than space and ``\\x09-\\x0D``, so the words of
``[^\\x20\\x09-\\x0D]+``: bytes above 127 never end one.  A 64-bit hash stands for a word
(upper-case A-Z folded on demand); it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[name] = np.cumprod(factors, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offset of each text; null is empty."""
    array = column.cast(pa.large_string()).fill_null("")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or one longer text."""
    if not len(column):
        return
    _, offsets = flat(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, start, end)`` of every word, in order."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    finals = offsets[1:][offsets[1:] > 0] - 1
    last[finals] = inside[finals]
    starts = np.flatnonzero(first)
    return np.searchsorted(offsets, starts, "right") - 1, starts, np.flatnonzero(last) + 1


def hashed(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every word, in order."""
    row, starts, ends = spans(data, offsets)
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * up[: len(data)], out=total[1:])
    return row, mix((total[ends] - total[starts]) * down[starts])


def counts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, minlength=rows)


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where the words of each row begin; one more entry ends the last."""
    return np.concatenate([[0], np.cumsum(counts(row, rows))])


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on, as long as there are as many."""
    total = np.full(max(0, len(words) - size + 1), size, np.uint64) * _STEP
    for i in range(size):
        total = mix(total + words[i : len(total) + i])
    return total


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the distinct runs of ``width`` words; a shorter text is one run, no text none."""
    return np.unique(runs(words, min(width, len(words)))) if len(words) else words

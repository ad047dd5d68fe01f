"""Repetition inside texts, from the suffix array of their words.

A text's suffixes that share their first ``WINDOW`` words with another suffix are sorted by prefix doubling; the
rank arrays of the levels give the longest common prefix of neighbours.  The deepest LCP interval that holds a
suffix is as long as the larger of its two neighbouring values, and its substring is a maximal repeat unless the
suffix one word to the left repeats the same and one word more.  Many texts are sorted at once, each by itself.
Words are compared through 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from talkweave.llm import words as w

WINDOW = 8
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "n_maximal", "longest_repeat")


def _repeated(row: np.ndarray, words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Positions whose next ``WINDOW`` words recur in their text, in order."""
    n = len(words)
    total = w.mix(row.astype(np.uint64))
    for i in range(WINDOW):
        total = w.mix(total + words[np.minimum(np.arange(n) + i, n - 1)])
    whole = np.flatnonzero(np.arange(n) + WINDOW <= last)
    _, group, times = np.unique(total[whole], return_inverse=True, return_counts=True)
    return whole[times[group] > 1]


def _window_ranks(words: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranks of the next ``WINDOW`` words of each position, in one order of words; the end of a text comes first."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1] + 1
    size = 1
    while size < WINDOW:
        ahead = np.arange(n) + size
        follow = np.where(ahead < last, rank[np.minimum(ahead, n - 1)], 0)
        rank = np.unique(rank * (n + 1) + follow, return_inverse=True)[1] + 1
        size *= 2
    return rank


def longest_matches(row: np.ndarray, words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(position, length)`` of every word position whose next ``WINDOW`` words recur in its text."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    active = _repeated(row, words, edge[row + 1])
    if not len(active):
        return active, active
    # Only texts with a repeat are sorted.
    place = np.flatnonzero(np.isin(row, np.unique(row[active])))
    active = np.searchsorted(place, active)
    row, words = row[place], words[place]
    n = len(row)
    last = np.searchsorted(row, row, "right")
    window = _window_ranks(words, last)
    rank = window * (n + 1)
    levels, size = [rank], WINDOW
    active = active[np.lexsort((window[active], row[active]))]
    while True:
        ahead = active + size
        follow = np.where(ahead < last[active], rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((follow, rank[active], row[active]))
        active, follow = active[order], follow[order]
        own, text, first = rank[active], row[active], window[active]
        outer = np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] != first[:-1])])
        starts = outer | np.concatenate([[True], (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])])
        number = np.cumsum(starts)
        rank = rank.copy()
        rank[active] = first * (n + 1) + number - number[np.flatnonzero(outer)[np.cumsum(outer) - 1]]
        if starts.all():
            break
        levels.append(rank)
        size *= 2
    # Longest common prefixes of neighbours, from the widest level down, then word by word.
    a, b = active[:-1].copy(), active[1:].copy()
    ends_a, ends_b, lcp = last[a], last[b], np.zeros(len(a), np.int64)
    one_text = row[a] == row[b]
    for k in range(len(levels) - 1, -1, -1):
        here = one_text & (a < ends_a) & (b < ends_b)
        here &= levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
        for x in (a, b, lcp):
            x[here] += WINDOW << k
    going = lcp > 0
    for _ in range(WINDOW - 1):
        going &= (a < ends_a) & (b < ends_b)
        going &= words[np.minimum(a, n - 1)] == words[np.minimum(b, n - 1)]
        for x in (a, b, lcp):
            x[going] += 1
    length = np.zeros(len(active), np.int64)
    length[:-1] = lcp
    np.maximum(length[1:], lcp, out=length[1:])
    order = np.argsort(active)
    return place[active[order]], length[order]


def _covered(at: np.ndarray, length: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words of each text inside any of the spans."""
    steps = np.bincount(at, minlength=len(row) + 1) - np.bincount(at + length, minlength=len(row) + 1)
    return np.bincount(row[np.cumsum(steps[: len(row)]) > 0], minlength=rows)


def _measure(column: pa.Array, least: int) -> list[np.ndarray]:
    data, offsets = w.flat(column)
    rows = len(column)
    row, words = w.hashed(data, offsets, fold=False)
    at, length = longest_matches(row, words, w.bounds(row, rows))
    per_row = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    long = length >= least
    at_long, length_long = at[long], length[long]
    inner = np.zeros(len(at_long), bool)
    inner[1:] = (at_long[1:] == at_long[:-1] + 1) & (length_long[1:] == length_long[:-1] - 1)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row[at], length)
    return [
        w.counts(row, rows),
        per_row((~_CONTINUES & ~_SPACE).astype(np.int64)),
        per_row(_SYMBOL.astype(np.int64)),
        np.array([_repeated_lines(t) for t in column.to_pylist()], np.int64),
        _covered(at, np.full(len(at), WINDOW), row, rows),
        _covered(at_long, length_long, row, rows),
        np.bincount(row[at_long[~inner]], minlength=rows),
        longest,
    ]


def _repeated_lines(text: str | None) -> int:
    lines = [line for line in (text or "").split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repetition(text: Column, least: int = 16) -> Column:
    """A struct of counts for each text; a null text counts as empty and gives zeros.

    ``n_words`` and ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word equal to
    an earlier one), ``n_repeat_words`` (words in windows of eight that recur), ``n_covered_words`` (words in repeats of
    at least ``least`` words), ``n_maximal`` (such repeats that cannot be extended) and ``longest_repeat`` (words of the
    longest recurring run, zero below eight).  Copies that overlap, as in one word written a thousand times, count too.
    """

    @F.arrow_udf(StructType([StructField(name, LongType()) for name in STATS]))
    def measure(column: pa.Array) -> pa.Array:
        parts = [_measure(column.slice(low, high - low), least) for low, high in w.slices(column)]
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(STATS)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], STATS)

    return measure(text)


def base_failed(stats: str) -> Column:
    """Fewer than 20 words, or over 30 % of the words in recurring windows of eight."""
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def kept(stats: str, max_covered_percent: int = 20, max_longest: int = 200) -> Column:
    """Not failed by the base, at most so many percent of the words in long repeats, and none longer than the limit."""
    s = lambda c: F.col(f"{stats}.{c}")
    return ~base_failed(stats) & (100 * s("n_covered_words") <= max_covered_percent * s("n_words")) & (s("longest_repeat") <= max_longest)

"""Polynomial hashes of words, word windows and byte windows, vectorised over a buffer of text.

A hash is taken modulo 2**64 with a random table for bytes and an odd base, then mixed.  A prefix sum
of ``table[byte] * base**position`` gives the hash of any stretch as a difference, scaled back by the
inverse power of the base, so all words or windows of a buffer cost a few passes of numpy.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: The bytes that part words: a space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Odd bases, and seeds of the byte tables, of the two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEEDS = (11, 29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _table(lane: int) -> np.ndarray:
    return np.random.default_rng(SEEDS[lane]).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_powers: dict[tuple[int, bool], np.ndarray] = {}
POWER_STEP = 1 << 18


def powers(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of a base, or of its inverse modulo 2**64; kept until ``forget``, whole steps of them."""
    have = _powers.get((lane, inverse))
    if have is None or len(have) < n:
        base = pow(BASES[lane], -1, 1 << 64) if inverse else BASES[lane]
        step = np.full(-(-max(n, 1) // POWER_STEP) * POWER_STEP, base, np.uint64)
        step[0] = 1
        have = _powers[lane, inverse] = np.multiply.accumulate(step)
    return have[:n]


def forget() -> None:
    """Drop the powers: a reused worker would keep some hundred megabytes of them between tasks."""
    _powers.clear()


def word_spans(buf: np.ndarray, starts: np.ndarray, parting: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer of texts, and the text of each; starts: of the texts, and the end."""
    space = parting[buf]
    edge = np.ones(len(buf) + 1, bool)
    edge[:-1] = space
    begin = ~space
    begin[1:] &= space[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    begin[heads] = ~space[heads]
    first = np.flatnonzero(begin)
    # a word ends at white space or where the next text starts
    stop = edge
    stop[heads] = True
    ends = np.flatnonzero(stop)
    last = ends[np.searchsorted(ends, first, side="right")]
    return first, last, np.searchsorted(starts, first, side="right") - 1


def stretch_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of values[first:last] for each pair."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(lane, len(values)), out=sums[1:])
    return mix((sums[last] - sums[first]) * powers(lane, len(values) + 1, True)[first])


def word_hashes(buf: np.ndarray, first: np.ndarray, last: np.ndarray, lane: int = 0) -> np.ndarray:
    return stretch_hashes(_table(lane)[buf], first, last, lane)


def windows(hashes: np.ndarray, texts: np.ndarray, size: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window of so many words of one text starts, and the windows' hashes."""
    at = np.arange(max(0, len(hashes) - size + 1))
    at = at[texts[at] == texts[at + size - 1]] if len(at) else at
    return at, stretch_hashes(hashes, at, at + size, lane)


def byte_grams(buf: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """Hashes of all stretches of so many bytes, at each start."""
    if len(buf) < size:
        return np.zeros(0, np.uint64)
    at = np.arange(len(buf) - size + 1)
    return stretch_hashes(_table(lane)[buf], at, at + size, lane)


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie within stretches of one size."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, np.minimum(starts + size, n), 1)
    return np.cumsum(edge[:-1]) > 0

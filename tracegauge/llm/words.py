"""Hashes of words and of runs of words, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE_FOLDED = _BYTE[_FOLD]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a longer text is its own piece.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        room = max(n, 4096)
        have = np.ones(room, dtype=np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if room <= 4 * PIECE:
            _POWERS[base] = have
    return have[:n]


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a string or binary array as (first row, their bytes, offsets into these). Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        yield first, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of a piece, and the number of the first word of each row (one
    more entry than rows). Words never cross rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64)
    head = np.zeros(len(data), np.int64)
    head[starts] = starts
    place -= np.maximum.accumulate(head)
    value = (_BYTE_FOLDED if fold else _BYTE)[data]
    value[_SPACE[data]] = 0
    np.minimum(place, int((ends - starts).max()), out=place)
    value *= powers(int(_STEP), int(place.max()) + 1)[place]
    return mix(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def run_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive items (64-bit hashes themselves)."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        total = items[:n].copy()
        for j in range(1, size):
            total *= _STEP
            total += items[j : j + n]
        return mix(total)
    inverse = pow(int(_STEP), -1, 1 << 64)
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * powers(int(_STEP), len(items)), out=sums[1:])
    return mix((sums[size:] - sums[: n]) * powers(inverse, n))


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest of every ``size`` consecutive values, the leftmost of equal ones."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, width = values, np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        take = best[step:] < best[:-step]
        at = np.where(take, at[step:], at[:-step])
        best = np.where(take, best[step:], best[:-step])
        width += step
    return at[:n]


def byte_items(data: np.ndarray) -> np.ndarray:
    """A 64-bit number for each byte."""
    return _BYTE[data]

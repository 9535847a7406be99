"""Words of a batch of texts as 64-bit hashes, computed over the whole batch at once with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablewright.llm.common import byte_view

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 18
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _SEGMENT)
        both = []
        for step in (_BASE, _INVERSE):
            factors = np.full(size, step, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        if n > 4 * _SEGMENT:
            return both[0], both[1]
        _powers = (both[0], both[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end] for sorted, non-overlapping spans; the same content gives the same hash anywhere."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        upto = max(int(np.searchsorted(ends, base + _SEGMENT, side="right")), at + 1)
        s, e = starts[at:upto] - base, ends[at:upto] - base
        size = int(e[-1])
        ahead, back = powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((symbols[base : base + size].astype(np.uint64) + np.uint64(1)) * ahead[:size], out=total[1:])
        out[at:upto] = (total[e] - total[s]) * back[s]
        at = upto
    return mix(out)


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words ``[^ \\t-\\r]+`` of all texts, A-Z lower-cased: their hashes, and the offsets of each row's words."""
    data, offsets = byte_view(texts)
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    inside = ~_IS_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[:-1] = first[1:] | ~inside[1:]
    last[-1] = True
    starts = np.flatnonzero(first & inside)
    ends = np.flatnonzero(last & inside) + 1
    words = span_hashes(_LOWERED[data], starts, ends)
    return words, np.searchsorted(starts, offsets, side="left")

"""Words and byte strings of many texts at once, in numpy.

A slice of an Arrow column is one byte array with row offsets. Words are runs
of bytes marked in a 256-entry table, so they are found for all rows in a few
array operations; a multi-byte character's bytes are all marked alike. Strings
are hashed as polynomials over random 64-bit values of their bytes (arithmetic
modulo 2**64, odd base), which makes the hash of any span a difference of two
running sums.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 4 + 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        row = np.full(size, base, dtype=np.uint64)
        row[0] = 1
        have = _powers[kind] = np.multiply.accumulate(row)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` reads (one more than bytes)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    if len(data):
        np.cumsum(BYTE_VALUES[data] * powers("base", BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for arrays of spans, the length mixed in."""
    back = powers("back", BASE_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each row's first word (one more than
    rows). Words don't cross rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = in_word[data]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # a row's start in the middle of a run cuts the run
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]] if len(cuts) else cuts
    if len(cuts):
        starts = np.sort(np.concatenate([starts, cuts]))
        ends = np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)

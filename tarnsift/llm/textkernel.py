"""Vectorised words of Arrow text batches: no Python object a word."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Of the C library, where it has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Texts are handled in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 4_000_000

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]
#: Powers that a worker keeps between tasks; longer texts make theirs again.
_KEPT = 1 << 20


def give_back() -> None:
    """Return what this worker doesn't use to the system: it stays alive after its task, idle or not."""
    _powers[:] = [p if len(p) <= _KEPT else p[:_KEPT].copy() for p in _powers]
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(run):
    """An Arrow function of batches that gives memory back when it ends."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, _U(base))
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z in lower case."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTES[_LOWER[data]] * up[:-1], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


_PLACES = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles; all its words as one if there are fewer."""
    starts, ends, row = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n_rows = len(offsets) - 1
    bounds = np.searchsorted(row, np.arange(n_rows + 1))
    n = len(words) - size + 1
    whole = np.zeros(max(n, 0), dtype=_U)
    for k in range(size):
        if n > 0:
            whole += words[k:k + n] * _PLACES[k]
    whole = mix(whole)
    out = []
    for i in range(n_rows):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            out.append(np.unique(whole[a:b - size + 1]))
        elif b > a:
            h = np.zeros(1, dtype=_U)
            for k in range(b - a):
                h += words[a + k:a + k + 1] * _PLACES[k]
            out.append(mix(h + _U(int(b - a))))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def grouped_sums(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Hash of the multiset of values of each group: exact sums of both halves, mixed."""
    low = np.bincount(group, weights=(values & _U(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(_U)
    high = np.bincount(group, weights=(values >> _U(32)).astype(np.float64), minlength=n).astype(_U)
    return mix(mix(low) + high * _U(0xD6E8FEB86659FD93))

"""Hashed shingle sets of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit (splitmix64's finaliser)."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _LOWER[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(n: int, base: int, made: dict = {}) -> np.ndarray:  # noqa: B006  kept between batches
    """1, base, base squared, ... modulo 2**64."""
    if n > len(made.get(base, ())):
        size = max(2 * _BLOCK, n)
        p = np.full(size, base, _U)
        p[0] = 1
        out = np.multiply.accumulate(p)
        if n > 2 * _BLOCK:
            return out
        made[base] = out
    return made[base][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return data, bounds - bounds[0] if n else np.zeros(1, np.int64)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word (A-Z lower-cased), and each row's bounds among the words."""
    space = _IS_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    first = ~space
    first[1:] &= space[:-1] | cut[1:-1]
    last = ~space
    last[:-1] &= space[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):  # blocks of whole words of about _BLOCK bytes bound the memory
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BLOCK)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_LOWER[data[lo:hi]] * powers(hi - lo, _BASE), out=total[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[b] - total[a]) * powers(hi - lo, _INVERSE)[a] + (b - a).astype(_U)
        at = to
    return mix64(out), np.searchsorted(starts, bounds)


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words; the places' factors are unrelated, so other orders of the words differ."""
    n = len(words) - width + 1
    out = np.zeros(n, _U)
    for k, factor in enumerate(mix64(np.arange(1, width + 1, dtype=_U) * _U(_BASE)) | _U(1)):
        out += words[k : k + n] * factor
    return mix64(out + _U(width))


def sorted_set(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]


def _slices(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of rows of about so many bytes; a longer text is a run of its own."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) if len(column) else np.zeros(0, np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield column.slice(at, to - at)
        at = to


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Each row's sorted set of word shingle hashes; a text with fewer words has one shingle, one without words none."""
    for part in _slices(column, 4 * _BLOCK):
        data, bounds = buffers(part)
        words, at = word_hashes(data, bounds)
        runs = folded(words, width) if len(words) >= width else np.zeros(0, _U)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                yield sorted_set(runs[a : b - width + 1])
            elif n:
                yield folded(words[a:b], n)
            else:
                yield np.zeros(0, _U)


def char_shingles(data: bytes, width: int) -> np.ndarray:
    """The sorted set of hashes of a line's runs of `width` code points (fewer: the whole line as one)."""
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(_U)
    return sorted_set(folded(mix64(points + _U(1)), min(width, len(points)))) if len(points) else np.zeros(0, _U)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0

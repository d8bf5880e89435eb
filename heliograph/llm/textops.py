"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on Arrow string columns inside ``mapInArrow`` tasks: the
UTF-8 bytes of many documents are looked at as one ``uint8`` array, so the cost
per word is a handful of array operations and no Python object is made for it.

Hashes are 64 bits wide.  A word's hash is the value of its bytes as a
polynomial modulo 2**64 with an odd base, taken out of one running sum for the
whole chunk, then mixed with the word's length; shingles mix the hashes of
their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are looked at together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse (kept per process)."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), other for each seed."""
    x = x + U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mix_int(x: int, seed: int = 0) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=U), seed)[0])


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``size`` bytes."""
    data, offsets = flat(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """The words of a chunk: maximal runs of bytes other than ASCII white space.

    ``h`` hashes, ``start``/``end`` byte positions, ``bounds[i]:bounds[i+1]`` the
    words of row i.  A-Z are lower-cased before hashing unless ``lower`` is false.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, rough: np.ndarray | None = None):
        n = len(data)
        gap = _SPACE[data] if rough is None else rough[data]
        first = ~gap
        first[1:] &= gap[:-1]
        begin = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begin] = ~gap[begin]
        last = ~gap
        last[:-1] &= gap[1:]
        final = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[final] = ~gap[final]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(n + 1)
        text = _LOWER[data] if lower else data
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((text.astype(U) + U(1)) * up[:n], out=total[1:])
        h = (total[self.end] - total[self.start]) * down[self.start]
        self.h = mix(h + (self.end - self.start).astype(U) * U(0xA0761D6478BD642F))
        self.bounds = np.searchsorted(self.start, offsets)


def row_of(bounds: np.ndarray, n: int | None = None) -> np.ndarray:
    """For each element of a chunk, the row whose bounds hold it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _size_seed(k: int) -> np.uint64:
    return U(k * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)


def _mix_words(h: np.ndarray, k: int, n: int) -> np.ndarray:
    out = np.full(n, _size_seed(k), dtype=U)
    for j in range(k):
        out += mix(h[j : j + n], 17 + j)
    return mix(out)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order, with the bounds of each row.

    A row of 1 to k-1 words has one shingle, its whole sequence; a row without
    words has none.
    """
    bounds = words.bounds
    counts = np.diff(bounds)
    total = len(words.h)
    row = row_of(bounds)
    if total >= k:
        n = total - k + 1
        full = _mix_words(words.h, k, n)
        keep = row[:n] == row[k - 1 :]
        full, full_row = full[keep], row[:n][keep]
    else:
        full, full_row = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        parts, rows = [full], [full_row]
        for size in np.unique(counts[short]):
            at = short[counts[short] == size]
            out = np.full(len(at), _size_seed(int(size)), dtype=U)
            for j in range(int(size)):
                out += mix(words.h[bounds[at] + j], 17 + j)
            parts.append(mix(out))
            rows.append(at)
        full, full_row = np.concatenate(parts), np.concatenate(rows)
        order = np.argsort(full_row, kind="stable")
        full, full_row = full[order], full_row[order]
    return full, np.searchsorted(full_row, np.arange(len(bounds)))


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, with their bounds."""
    h = h.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    keep[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    return h[keep], np.concatenate(([0], np.cumsum(keep)))[bounds]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of each row's values (modulo 2**64 for unsigned values)."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]

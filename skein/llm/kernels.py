"""Vectorised kernels over the UTF-8 bytes of an Arrow string column.

Texts are handled whole. A batch is walked in slices of about SLICE bytes (always whole
rows), so that the working arrays stay small whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_S = 0xD1342543DE82EF95
#: ASCII white space, the only word separators here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def column(values: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string or binary column; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not (pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)):
        values = values.cast(pa.large_string() if pa.types.is_string(values.type) else pa.large_binary())
    if values.null_count:
        values = values.fill_null("" if pa.types.is_large_string(values.type) else b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(values: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole rows of about `size` bytes."""
    data, at = column(values)
    first, n = 0, len(at) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        end = min(end, first + 65536, n)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        n = 1 << max(10, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            p = np.full(n, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 1 << 23:  # a very long text: not kept
            return tuple(both)
        _powers[base] = tuple(both)
    return _powers[base]


def prefix(values: np.ndarray, base: int = _R) -> np.ndarray:
    """Polynomial prefix hashes; span() gives the hash of any range of values."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _R) -> np.ndarray:
    """Hash of values[start:end], independent of where the range stands."""
    return mix((hashes[end] - hashes[start]) * powers(base, len(hashes))[1][start] + (end - start).astype(U))


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, i.e. run of bytes other than ASCII white space."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = False
    start = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[first[1:] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span(prefix(data), start, end)


def grams(tokens: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k tokens within a row, and the run's first token."""
    if len(tokens) < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - k + 1] == rows[k - 1 :])
    return span(prefix(tokens, _S), at, at + k, _S), at


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i with a whole window."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash, its highest bits, is set in a filter of 2**n bits."""
    slot = (hashes >> U(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] values, then the same from starts[1], and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by the given half-open ranges; touching ranges join."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]

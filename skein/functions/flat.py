"""Arrays of strings and of tokens as flat NumPy arrays: code points, their places, and hashes of any stretch of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and single signs; explicit classes, because \w means other things to other engines.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Rows are worked on together up to so many characters or tokens; a longer row is worked on alone.
CHUNK = 1 << 16
#: Bits of a filter, a power of two. With more entries it lets more through to the exact steps after it.
FILTER = 1 << 26
SPACE, WORD, SIGN = 0, 1, 2

_BITS = 1 << np.arange(8, dtype=np.uint8)
_BASE, _MIX, _SALT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_tables: dict[str, np.ndarray] = {}


def chunks(weights: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that weigh CHUNK at most together, or are one row."""
    total, a = np.concatenate([[0], np.cumsum(weights)]), 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, "right")) - 1)
        yield a, b
        a = b


def utf8(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and the bounds of each in them; null is empty."""
    strings = pc.fill_null(strings.cast(pa.string()), "")
    _, places, data = strings.buffers()
    bounds = np.frombuffer(places, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same in code points."""
    raw, bounds = utf8(strings)
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), before[bounds]


def classes() -> np.ndarray:
    """What each code point is to TOKEN_PATTERN."""
    if "classes" not in _tables:
        import regex

        table = np.full(0x110000, SIGN, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for m in regex.finditer(TOKEN_PATTERN.split("|")[0], every, regex.V0):
            table[m.start() : m.end()] = WORD
        table[[*range(9, 14), 32]] = SPACE
        _tables["classes"] = table
    return _tables["classes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to each power below n modulo 2^64, and to minus it."""
    if len(_tables.get("powers", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, x in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, x, np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table, dtype=np.uint64)
    return _tables["powers"], _tables["inverses"]


def sums(codes: np.ndarray) -> np.ndarray:
    """What `rolls` and `rolled` need of code points."""
    powers, _ = _powers(len(codes) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], dtype=np.uint64)])


def rolls(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """64 bits of each stretch of code points."""
    _, inverses = _powers(len(sums))
    return (sums[start + size] - sums[start]) * inverses[start]


def rolled(sums: np.ndarray, size: int) -> np.ndarray:
    """The same of all stretches of one size."""
    n = max(0, len(sums) - size)
    return (sums[size:] - sums[:n]) * _powers(len(sums))[1][:n]


def joined(parts: Sequence[np.ndarray]) -> np.ndarray:
    """One of several stretches' 64 bits."""
    h = parts[0]
    for other in parts[1:]:
        h = h * np.uint64(_MIX) + other
    return h


def slots(rolls: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """Places in a filter of stretches and a salt."""
    h = (rolls + np.asarray(salt).astype(np.uint64) * np.uint64(_SALT)) * np.uint64(_MIX)
    h >>= np.uint64(65 - FILTER.bit_length())
    return h.view(np.int64)


def may_hold(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 3] & _BITS[at & 7] > 0


def string_array(raw: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of so many bytes each."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))


def list_array(bounds: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    mask = None if null is None or not null.any() else pa.array(null)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=mask)


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bounds of an array of lists in its values, the values, and which lists are null; these are empty."""
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten(), null


def by_chunks(column: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """f of an array of lists, some of its rows at a time."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pa.concat_arrays([f(column.slice(a, b - a)) for a, b in chunks(sizes)] or [f(column)])

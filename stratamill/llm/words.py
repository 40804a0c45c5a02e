"""Words of Arrow text columns as numpy arrays, for code that runs inside tasks.

Texts are walked in pieces of half a MB, so that temporary arrays stay small; a
single text is never cut. Words are named by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together.
PIECE = 512 << 10

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII white space, and everything in ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
MARKS = np.zeros(256, bool)
MARKS[:128] = [not chr(c).isalnum() for c in range(128)]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_EXACT = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE = _EXACT[_LOWER]
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        n = max(n, 1 << 16)
        for k, b in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(n, b, _U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers["p"], _powers["i"]


_kept: dict = {}


def kept(owner: str, key, make):
    """What a worker keeps for later tasks. It keeps things of one operator only: those of others go when another one begins."""
    if _kept.get("owner") != owner:
        _kept.clear()
        _kept["owner"] = owner
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Drop what is kept: a step that needs none of it doesn't carry it along."""
    _kept.clear()


def lowered(col: pa.Array) -> pa.Array:
    """The column in lower case by Unicode."""
    return pc.utf8_lower(col)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where its rows begin (one more than rows); null is empty."""
    if pa.types.is_dictionary(col.type):
        col = col.dictionary_decode()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages, and share an executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE, by: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of the column `by`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(batch.schema.get_field_index(by)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            last = min(last, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    give_back()


def words(col: pa.Array, apart: np.ndarray, exact: bool = False, cuts=None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end, bytes): the words of every row in order; `apart` says which bytes separate. A-Z count as a-z, unless `exact`. cuts(bytes) tells before which bytes words are cut, too."""
    data, at = buffers(col)
    low = int(at[0])
    data, at = data[low : int(at[-1])], at - low
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none.astype(_U), none, none, data
    inside = ~apart[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    if cuts is not None:
        edge |= cuts(data)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    row = np.searchsorted(at, start, "right") - 1
    power, inverse = _power(n + 1)
    total = np.empty(n + 1, _U)
    total[0] = 0
    np.cumsum((_EXACT if exact else _BYTE)[data] * power[:n], out=total[1:])
    return row, mix64((total[end] - total[start]) * inverse[start]), start, end, data

"""Words of whole texts as arrays: boundaries and 64-bit identities, one pass over the bytes.

Works on Arrow string columns inside a task. A word is a maximal run of bytes of a given class,
so it never depends on how Spark cut the rows into batches.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1B54A32D192ED03
_WINDOW = 1 << 20
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (overwrites nothing)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(keep) -> np.ndarray:
    """Lookup table of the bytes for which ``keep(byte)`` holds."""
    return np.array([bool(keep(b)) for b in range(256)])


#: everything but space and the controls 09-0D
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ASCII letters and digits and every byte of a character beyond ASCII
WORDLIKE = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)[_FOLD]
_BYTE_CODE_CASED = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    base = np.full(n, _BASE, np.uint64)
    back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(base), np.multiply.accumulate(back)


def give_back() -> None:
    """Return what this worker has freed to the system; workers live on and serve the next stages too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(result):
    """``result``, after what made it has been given back."""
    give_back()
    return result


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    give_back()
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word and, per row, the index of its first word (n + 1 values)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = kept[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(raw))]  # words never run over the limit of a row
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, at)


def span_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, *, fold: bool = True) -> np.ndarray:
    """64-bit identity of each span of bytes (A-Z folded to a-z if ``fold``).

    The spans are in order and don't overlap. Equal spans have equal codes; different spans of a
    comparison share one with probability about 2**-64.
    """
    code = np.empty(len(start), np.uint64)
    table = _BYTE_CODE if fold else _BYTE_CODE_CASED
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + _WINDOW, side="right")))
        a, b = int(start[lo]), int(end[hi - 1])
        n = b - a
        up, down = _powers(_WINDOW if n <= _WINDOW else 1 << n.bit_length())
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[raw[a:b]] * up[:n], out=total[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        code[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        lo = hi
    return code


def windows(code: np.ndarray, size: int) -> np.ndarray:
    """Identity of each run of ``size`` consecutive codes, by first position."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(_BASE)
        out += code[i : i + n]
    return mix(out)

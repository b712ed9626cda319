"""Exact quantiles of many columns at once by radix selection.

A double becomes a 64-bit code of the same order. A pass counts the next 16 bits of the codes of every
column, in its first round of all values, later of those only that share the bits of a wanted rank so far;
counts are merged by one aggregate, so what comes to the driver is at most 65 536 rows for each column and
rank, whatever the table. A rank is found as soon as its bucket holds one value: two passes where values
repeat or have few digits, four at most. Nothing is exploded, ordered, joined or estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DIGIT = 16
_TOP = np.uint64(1 << 63)
_LEVELS = 64 // _DIGIT


def codes_of(values: np.ndarray) -> np.ndarray:
    """Unsigned codes in the order of the doubles (NaN last)."""
    bits = np.ascontiguousarray(values, np.float64).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def value_of(code: int) -> float:
    bits = np.uint64(code)
    bits = bits ^ _TOP if bits >= _TOP else ~bits
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _signed(codes: np.ndarray) -> np.ndarray:
    """Codes as signed numbers of the same order."""
    return (codes ^ _TOP).view(np.int64)


def _unsigned(number: int) -> int:
    return number + (1 << 63)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts, least and largest code per prefix."""
    prefix, n, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(prefix, kind="stable")
    prefix, n, low, high = prefix[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    return prefix[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)


def _counts(df: DataFrame, cols: Sequence[str], level: int, wanted: Sequence[np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per column: prefixes of (level + 1) digits, their counts, and the least and largest code of each."""
    shift = np.uint64(64 - _DIGIT * (level + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in cols]
        for batch in batches:
            for j in range(len(cols)):
                code = codes_of(pc.drop_null(batch.column(j)).to_numpy(zero_copy_only=False))
                if level:
                    parent = code >> np.uint64(64 - _DIGIT * level)
                    at = np.minimum(np.searchsorted(wanted[j], parent), max(len(wanted[j]) - 1, 0))
                    code = code[wanted[j][at] == parent] if len(wanted[j]) else code[:0]
                if not len(code):
                    continue
                code = np.sort(code)
                prefix = code >> shift
                first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                last = np.append(first[1:], len(code)) - 1
                held[j].append((prefix[first], last - first + 1, code[first], code[last]))
                if len(held[j]) == 64:
                    held[j] = [_merged(held[j])]
        for j, parts in enumerate(held):
            if parts:
                prefix, n, low, high = _merged(parts)
                yield pa.record_batch(
                    [pa.array(np.full(len(prefix), j, np.int32)), pa.array(_signed(prefix)), pa.array(n.astype(np.int64)), pa.array(_signed(low)), pa.array(_signed(high))],
                    names=["col", "prefix", "n", "low", "high"],
                )

    found = df.mapInArrow(count, "col int, prefix long, n long, low long, high long")
    merged = found.groupBy("col", "prefix").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
    out = {}
    table = {c: merged[c].to_numpy() for c in merged.column_names}
    for j in range(len(cols)):
        mine = np.flatnonzero(table["col"] == j)
        mine = mine[np.argsort(table["prefix"][mine])]
        out[j] = tuple(table[c][mine] for c in ("prefix", "n", "low", "high"))
    return out


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Mapping[str, float]) -> dict[str, dict[str, float | None]]:
    """Linearly interpolated quantiles of each column (null where it has no value), and its count as ``n``.

    One value per column and probability reaches the driver.
    """
    if not cols:
        return {}
    plain = df.select(*[F.col(c).cast("double").alias(f"_{j}") for j, c in enumerate(cols)])
    total = [0] * len(cols)
    found: dict[tuple[int, int], float] = {}  # (column, rank) -> value
    open_: dict[tuple[int, int], tuple[int, int]] = {}  # (column, rank) -> (prefix so far, values before it)
    for level in range(_LEVELS):
        wanted = [np.array(sorted({p for (c, _), (p, _) in open_.items() if c == j}), np.uint64) for j in range(len(cols))]
        counts = _counts(plain, cols, level, wanted)
        if not level:
            for j, (_, n, _, _) in counts.items():
                total[j] = int(n.sum())
                for p in probs.values() if total[j] else ():
                    place = p * (total[j] - 1)
                    open_ |= {(j, r): (0, 0) for r in (math.floor(place), math.ceil(place))}
        for (j, rank), (parent, before) in list(open_.items()):
            prefix, n, low, high = counts[j]
            if level:
                edge = [parent << _DIGIT, (parent + 1) << _DIGIT]
                a, b = np.searchsorted(prefix, [e - (1 << 63) if e < 1 << 64 else np.iinfo(np.int64).max for e in edge])
                b = len(prefix) if edge[1] >= 1 << 64 else b
                prefix, n, low, high = (x[a:b] for x in (prefix, n, low, high))
            upto = before + np.cumsum(n)
            k = int(np.searchsorted(upto, rank, side="right"))
            if low[k] == high[k]:
                found[j, rank] = value_of(_unsigned(int(low[k])))
                del open_[j, rank]
            else:
                open_[j, rank] = (_unsigned(int(prefix[k])), int(upto[k] - n[k]))
        if not open_:
            break
    out: dict[str, dict[str, float | None]] = {}
    for j, c in enumerate(cols):
        row: dict[str, float | None] = {"n": total[j]}
        for name, p in probs.items():
            place = p * (total[j] - 1)
            if total[j]:
                lo, hi = found[j, math.floor(place)], found[j, math.ceil(place)]
                row[name] = lo if lo == hi else lo + (place - math.floor(place)) * (hi - lo)
            else:
                row[name] = None
        out[c] = row
    return out

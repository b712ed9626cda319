"""Runs: maximal periodic stretches of words, from the maximal pairs of a text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
2 q and ``LEAST`` words long, that no neighbouring word extends keeping q. Its first word and the word q
later begin a *maximal pair*: equal stretches of ``length - q`` words, at least q, that differ before and after.
The other way round, a maximal pair whose distance q is at most its length is a run of period q or of
a divisor, with the same ends, so the smallest distance of equal ends is the period and nothing needs to be
extended.

Maximal pairs come from the LCP-interval tree of a text's suffixes, walked bottom-up: each interval holds
its suffixes in lists by left word (the word before), and where intervals meet, only suffixes of
different left words and within the length's distance are paired, the smaller interval's against the larger's.

Two whole-array passes keep the tree small. Words that are equal over 6, 12, 24, ... words form classes; a pair
of length k to 2 k lies in one class of k words, and no gap of the class between its two suffixes reaches 2 k. So
only clusters of a class with gaps below 2 k and two or more left words hold any suffix of a pair. Texts with such
clusters get a suffix array by prefix doubling (equal word codes, one sort a doubling), and only
the suffixes in clusters become leaves.

Null and empty texts have no words and no runs: n_runs 0, nulls for the longest run, digests of the empty
string. Every row is its own text, so repeated rows and null ids give a row each; other columns are ignored;
an empty table gives none. A text is one task's work: about 4 bytes a word for each doubling up to its
longest repeat. Words are told apart by 64-bit codes of their bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.code_index import gather
from fleetcast.llm.words import NOT_BLANK, mix, slices, span_codes, text_bytes, windows, word_spans

LEAST = 12
_SLICE = 4 << 20
#: left word of a text's first word
_NONE = -1


def _dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number of each key (ascending with the key) and the order that sorts the keys."""
    order = np.argsort(keys, kind="stable")
    step = np.concatenate([[False], keys[order][1:] != keys[order][:-1]]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(step)
    return out, order


def clustered(code: np.ndarray, at: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Positions that may begin a suffix of a maximal pair, ascending.

    ``code`` are the words of some texts, ``at`` where each text begins (n + 1 values).
    """
    n, k = len(code), least // 2
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left = np.concatenate([[0], code[:-1]]).astype(np.uint64) if n else code
    left[at[:-1][np.diff(at) > 0]] = mix(np.array([1], np.uint64))[0]  # no word
    whole = np.flatnonzero(np.arange(n) + k <= at[1:][text]) if n else np.zeros(0, np.int64)
    if not len(whole):
        return whole
    # equal stretches of k words inside a text; later levels compare class numbers only
    key = windows(code, k)[whole] ^ mix(text[whole].astype(np.uint64) + np.uint64(1))
    found = np.zeros(n, bool)
    where = np.empty(n, np.int64)  # class of a position at this level, -1 for those that are alone
    pos = whole
    while len(pos):
        order = np.lexsort((pos, key)) if key.dtype != np.uint64 else np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        size = np.diff(np.append(np.flatnonzero(new), len(new)))
        shared = np.repeat(size > 1, size)
        pos, new = pos[shared], new[shared]
        if not len(pos):
            break
        cls = np.cumsum(new) - 1
        # clusters: stretches of a class with gaps below 2 k
        apart = new | (np.diff(pos, prepend=pos[0]) >= 2 * k)
        cluster = np.cumsum(apart) - 1
        begin = np.flatnonzero(apart)
        many = np.diff(np.append(begin, len(pos)))
        mixed = np.zeros(len(begin), bool)
        mixed[cluster[left[pos] != left[pos[begin]][cluster]]] = True
        found[pos[(mixed & (many > 1))[cluster]]] = True
        where.fill(-1)
        where[pos] = cls
        # a stretch of 2 k is a pair of stretches of k
        on = pos + k < n
        second = where[pos[on] + k]
        go = (second >= 0) & (text[pos[on]] == text[np.minimum(pos[on] + k, n - 1)])
        key = cls[on][go] * np.int64(n + 1) + second[go]
        pos = pos[on][go]
        k *= 2
    return np.flatnonzero(found)


def suffix_levels(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes (texts apart) as ranks, and the ranks by 1, 2, 4, ... words before the last doubling.

    Equal ranks of level t are equal stretches of 2**t words inside a text (a stretch that the end of its text
    cuts short equals no other).
    """
    n = len(code)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = at[1:][text]
    word, _ = _dense(code)
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    rank = np.empty(n, np.int64)
    pos, levels, k = np.arange(n), [], 1
    base = np.zeros(n, np.int64)  # first rank of the group a position is in
    while True:
        order = np.lexsort((key, base[pos])) if levels else np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        old = base[pos]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])])
        first = np.flatnonzero(new)
        group_start = np.concatenate([[True], old[1:] != old[:-1]])
        origin = np.maximum.accumulate(np.where(group_start, np.arange(len(pos)), 0))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))
        rank[pos] = old + lead - origin
        base = rank.copy()
        size = np.diff(np.append(first, len(pos)))
        pos = pos[np.repeat(size > 1, size)]
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        if not len(pos):
            return rank, levels
        key = np.where(pos + k < end[pos], rank[np.minimum(pos + k, n - 1)] + 1, 0)
        k *= 2


def common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes i and j of a text have in common; ``end`` is the end of the text."""
    got = np.zeros(len(i), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        a, b = i + got, j + got
        inside = np.maximum(a, b) < end
        last = len(levels[t]) - 1
        same = inside & (levels[t][np.minimum(a, last)] == levels[t][np.minimum(b, last)])
        got += same.astype(np.int64) << t
    return got


class _Interval:
    """Suffixes of an LCP interval: all of them in order, and by left word."""

    __slots__ = ("all", "by_left")

    def __init__(self, pos: int, left: int):
        self.all = [pos]
        self.by_left = {left: [pos]}

    def meet(self, other: _Interval, length: int, least: int, out: list[tuple[int, int, int]]) -> _Interval:
        """Pairs between two child intervals of an interval of ``length``; returns their union."""
        big, small = (self, other) if len(self.all) >= len(other.all) else (other, self)
        for left, members in small.by_left.items():
            others = len(big.by_left) - (left in big.by_left)
            if not others:
                continue
            for x in members:
                lo, hi = bisect_left(big.all, x - length), bisect_right(big.all, x + length)
                if lo == hi:
                    continue
                if others <= hi - lo:
                    lists = (v for c, v in big.by_left.items() if c != left)
                    near = (y for v in lists for y in v[bisect_left(v, x - length) : bisect_right(v, x + length)])
                else:
                    own = big.by_left.get(left, ())
                    taken = set(own[bisect_left(own, x - length) : bisect_right(own, x + length)]) if own else ()
                    near = (y for y in big.all[lo:hi] if y not in taken)
                for y in near:
                    q = abs(x - y)
                    if q + length >= least:
                        out.append((min(x, y), q, length))
        for left, members in small.by_left.items():
            mine = big.by_left.setdefault(left, [])
            for x in members:
                insort(mine, x)
                insort(big.all, x)
        return big


def maximal_pairs(pos: list[int], left: list[int], lcp: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Maximal pairs (first suffix, distance, length) with distance <= length and distance + length >= ``least``.

    ``pos`` are suffixes in their order, ``lcp`` what each shares with the one before (0 between texts).
    A stack holds the open intervals; an interval is closed, hence complete, when the next suffix shares less.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Interval]] = []
    for k, p in enumerate(pos):
        now = _Interval(p, left[k])
        after = lcp[k + 1] if k + 1 < len(pos) else 0
        while stack and stack[-1][0] >= max(after, 1):
            length, open_ = stack.pop()
            now = open_.meet(now, length, least, out)
        if after * 2 >= least:
            stack.append((after, now))
    return out


def runs_of(code: np.ndarray, at: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start (inside the text), length and period of all runs, by text, start, period."""
    none = np.zeros(0, np.int64)
    leaf = clustered(code, at, least)
    if not len(leaf):
        return none, none, none, none
    # only texts that have leaves are sorted
    text = np.searchsorted(at, leaf, side="right") - 1
    texts = np.unique(text)
    size = np.diff(at)[texts]
    inner = np.concatenate([[0], np.cumsum(size)])
    words = code[gather(at[texts], size)]
    number = np.searchsorted(texts, text)
    p = leaf - at[text] + inner[number]
    rank, levels = suffix_levels(words, inner)
    order = np.argsort(rank[p])
    p, number = p[order], number[order]
    near = np.concatenate([[False], number[1:] == number[:-1]])
    lcp = np.zeros(len(p), np.int64)
    lcp[near] = common(levels, p[:-1][near[1:]], p[1:][near[1:]], inner[1:][number[1:][near[1:]]])
    first = p == inner[number]
    left = np.where(first, _NONE, levels[0][np.maximum(p - 1, 0)])
    found = maximal_pairs(p.tolist(), left.tolist(), lcp.tolist(), least)
    if not found:
        return none, none, none, none
    start, q, length = np.array(found, np.int64).T
    of = np.searchsorted(inner, start, side="right") - 1
    full = length + q
    # of equal ends the smallest distance is the period
    order = np.lexsort((q, full, start))
    start, q, full, of = start[order], q[order], full[order], of[order]
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (full[1:] != full[:-1])])
    start, q, full, of = start[keep], q[keep], full[keep], of[keep]
    order = np.lexsort((q, start, of))
    return texts[of[order]], (start - inner[of])[order], full[order], q[order]


def repeated_tail(n: int, h: int) -> np.ndarray:
    """Order of ``n`` words in which every word i >= a is word a + (i - a) % p; a and p follow from ``h``."""
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def _rearranged(at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Word order of all texts; texts with a seed divisible by 10 get a repeated tail (negative seeds none)."""
    order = np.arange(at[-1])
    for k in np.flatnonzero((seeds >= 0) & (seeds % 10 == 0) & (np.diff(at) > 0)).tolist():
        order[at[k] : at[k + 1]] = at[k] + repeated_tail(int(at[k + 1] - at[k]), int(seeds[k]))
    return order


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words joined by one space, text after text, and where each text begins and ends (with a last space)."""
    size = end - start + 1
    limit = np.concatenate([[0], np.cumsum(size)])
    out = np.full(limit[-1] + 1, 0x20, np.uint8)
    place = gather(start, size)
    out[:-1] = raw[np.minimum(place, max(len(raw) - 1, 0))] if len(raw) else 0
    out[limit[1:] - 1] = 0x20
    return out, limit[at]


_OUT = pa.schema(
    [
        *[(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")],
        ("runs_sha256", pa.string()),
        ("collapsed_sha256", pa.string()),
        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ]
)


def _found(part: pa.RecordBatch, least: int, texts: bool) -> pa.RecordBatch:
    raw, at = text_bytes(part.column("text"))
    start, end, first = word_spans(raw, at, NOT_BLANK)
    seeds = part.column("seed").fill_null(-1).to_numpy()
    order = _rearranged(first, seeds)
    code = span_codes(raw, start, end, fold=False)[order]
    n = part.num_rows
    text, begin, length, period = runs_of(code, first, least)
    limit = np.searchsorted(text, np.arange(n + 1))
    # words of a run after its first period go
    cover = np.zeros(len(order) + 1, np.int64)
    np.add.at(cover, first[text] + begin + period, 1)
    np.add.at(cover, first[text] + begin + length, -1)
    kept = np.cumsum(cover[:-1]) == 0
    left = order[kept]
    new_first = np.concatenate([[0], np.cumsum(kept)])[first]
    joined, place = _joined(raw, start[left], end[left], new_first)
    best = np.full((4, n), -1, np.int64)
    if len(text):
        ranked = np.lexsort((period, begin, -length, text))
        top = ranked[np.searchsorted(text[ranked], np.unique(text))]
        best[:, text[top]] = begin[top], length[top], period[top], 1000 * length[top] // period[top]
    empty = hashlib.sha256(b"").hexdigest()
    shas = [empty] * n
    for k in np.flatnonzero(np.diff(limit)).tolist():
        rows = zip(begin[limit[k] : limit[k + 1]].tolist(), length[limit[k] : limit[k + 1]].tolist(), period[limit[k] : limit[k + 1]].tolist(), strict=True)
        shas[k] = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in rows).encode()).hexdigest()
    spans = [(a, max(a, b - 1)) for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
    columns = {
        "n_runs": pa.array(np.diff(limit)),
        **{c: pa.array(best[k], pa.int64(), mask=best[k] < 0) for k, c in enumerate(("start", "length", "period", "exponent_milli"))},
        "runs_sha256": pa.array(shas, pa.string()),
        "collapsed_sha256": pa.array([hashlib.sha256(joined[a:b]).hexdigest() for a, b in spans], pa.string()),
    }
    if texts:
        listed = pa.StructArray.from_arrays([pa.array(v) for v in (begin, length, period)], ["start", "length", "period"])
        columns["runs"] = pa.ListArray.from_arrays(pa.array(limit, pa.int32()), listed)
        columns["collapsed"] = pa.array([joined[a:b].tobytes().decode() for a, b in spans], pa.string())
    return pa.record_batch([columns[f.name].cast(f.type) for f in _OUT if f.name in columns], names=[f.name for f in _OUT if f.name in columns])


def periodic_runs(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: Column | None = None, least: int = LEAST, texts: bool = False
) -> DataFrame:
    """Runs of each text: doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    With ``texts`` also ``runs`` (all of them) and ``collapsed``: the text without the words of a run after its first
    period, one space between words. ``seed`` (null: none) gives texts a repeated tail first, see ``repeated_tail``.
    """
    names = [f.name for f in _OUT][: None if texts else -2]
    kinds = {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>"} | {c: "string" for c in ("runs_sha256", "collapsed_sha256", "collapsed")}
    plain = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.lit(None) if seed is None else seed).cast("long").alias("seed")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                got = _found(part, least, texts)
                yield pa.record_batch([part.column("doc_id"), *got.columns], names=["doc_id", *names])

    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names)
    return plain.mapInArrow(scan, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {schema}")

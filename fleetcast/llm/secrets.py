"""Secret scanning: patterns, and sliding-window entropy per character class with an allow-list.

Three pattern kinds find whole matches: ``assign`` (a name like password, ``:`` or ``=``, a value of
six or more characters), ``access`` (AKIA keys of 20 or more characters) and ``hex`` (24 or more
lower-case hex digits). A fourth, ``entropy``, looks at candidate strings: a window slides over the
runs of each character class in the string, its Shannon entropy kept up by counts that change by
one character at either end; windows at or over the class's limit are joined to spans. Strings that
an allow-list knows (words, uuids, dates, links, paths) and spans inside a pattern match are not reported.

Positions are code points, ends exclusive. Null and empty texts have no span; a text is always
scanned whole; repeated documents are each scanned.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.words import give_back

KINDS = ("assign", "access", "hex", "entropy")
BASE_KINDS = KINDS[:3]

# fixed values: the pattern kinds
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
_HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)
_MIN_VALUE, _MIN_ACCESS = 6, 20

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)


@dataclass(frozen=True)
class CharClass:
    """Characters, window length and entropy limit in bits a character."""

    name: str
    pattern: re.Pattern
    window: int
    limit: float


CLASSES = (
    CharClass("upper hex", re.compile(r"[0-9A-F]{24,}"), 24, 3.0),
    CharClass("letters and digits", re.compile(r"[A-Za-z0-9]{20,}"), 20, 3.7),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/=]{28,}"), 28, 4.0),
    CharClass("url-safe base64", re.compile(r"[A-Za-z0-9_=-]{28,}"), 28, 4.0),
    # from the candidate minimum on: the limit is the same share of the most that a window can have
    CharClass("short base64", re.compile(r"[A-Za-z0-9+/=]{20,}"), 20, 4.0 * math.log2(20) / math.log2(28)),
    CharClass("short url-safe base64", re.compile(r"[A-Za-z0-9_=-]{20,}"), 20, 4.0 * math.log2(20) / math.log2(28)),
)

ALLOWED = (
    re.compile(r"[A-Za-z+/_=-]*"),  # no digit: words, separators
    re.compile(r"[0-9+/_=-]*"),  # no letter: numbers, dates, rulers
    re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*"),  # words and numbers joined: slugs, paths
)

_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

_TERM = [0.0] + [n * math.log2(n) for n in range(1, 65)]


def entropy_spans(string: str, window: int, limit: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``string`` whose entropy is ``limit`` or more."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    most = window * (math.log2(window) - limit) + 1e-9  # sum of n log n at the limit
    for i, c in enumerate(string):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= window:
            old = string[i - window]
            n = counts[old]
            total += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
        if i + 1 >= window and total <= most:
            start = i + 1 - window
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _high_entropy(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        if any(p.fullmatch(m[0]) for p in ALLOWED):
            continue
        for kind in CLASSES:
            for run in kind.pattern.finditer(m[0]):
                if any(p.fullmatch(run[0]) for p in ALLOWED):
                    continue
                base = m.start() + run.start()
                found += [(base + a, base + b) for a, b in entropy_spans(run[0], kind.window, kind.limit)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    taken = sorted(taken)
    out, k, reach = [], 0, -1
    for a, b in merged:  # one pass: how far the pattern matches that begin by a reach
        while k < len(taken) and taken[k][0] <= a:
            reach = max(reach, taken[k][1])
            k += 1
        if b > reach:
            out.append((a, b))
    return out


def secret_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind in the order of KINDS."""
    if not text:
        return []
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= _MIN_ACCESS]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found += [(a, b, 3) for a, b in _high_entropy(text, [(a, b) for a, b, _ in found])]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def _spans(texts: pa.Array) -> pa.Array:
    give_back()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = ([{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t.as_py())] for t in texts)
    return pa.array(rows, kind)


def find_secrets(docs: DataFrame, text: str = "text", result: str = "secrets") -> DataFrame:
    """``docs`` with an array column of spans (kind, start, end), in order."""
    return docs.withColumn(result, F.arrow_udf(_spans, _SPANS)(F.col(text)))


def secrets_summary(found: DataFrame, doc_id: str = "doc_id", result: str = "secrets") -> DataFrame:
    """Counts per pattern kind and the spans in text form."""
    spans = F.col(result)

    def joined(a):
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")

    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(F.filter(spans, lambda s: s.kind.isin(*BASE_KINDS))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
        count("entropy").alias("n_entropy"),
    )


def _masked(texts: pa.Array) -> pa.Array:
    give_back()
    out = []
    for t in texts:
        text = t.as_py()
        kept, last = [], 0
        for a, b, kind in secret_spans(text):
            if a >= last:
                kept += [text[last:a], f"<{kind}>"]
            last = max(last, b)
        out.append(text if not kept else "".join(kept) + text[last:])
    return pa.array(out, pa.string())


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span (overlapping ones together) replaced by the kind of its first, in angle brackets."""
    return docs.withColumn(text, F.arrow_udf(_masked, "string")(F.col(text)))

"""Benchmark decontamination: exact matches of benchmark word windows in whole documents.

Words are runs of ASCII letters and digits and characters beyond ASCII, A-Z lower-cased. A window
is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. The
windows go to the tasks as a set of hashes; a hit is verified word by word. Documents never move.

Null texts have no words. Items without words or without an id are left out. Repeated items count
once; repeated documents are each judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.frames import free_name, input_columns
from fleetcast.llm.words import SLICE_BYTES, WORDLIKE, slices, span_codes, text_bytes, windows, word_spans
from fleetcast.session import stage

#: windows shipped to the tasks at once (about 100 bytes each); more are taken in further passes
BLOCK_WINDOWS = 1 << 18

_TABLE_BITS = 22
_RESULT = "struct<n_words:bigint,hits:array<struct<start:bigint,end:bigint>>,items:array<string>>"


@dataclass
class WindowSet:
    """Windows of a block of items: by code, the words of each and the items that have it."""

    code: np.ndarray
    size: np.ndarray
    words: np.ndarray
    item: np.ndarray
    names: list[str]

    def __post_init__(self):
        self.maybe = np.zeros(1 << _TABLE_BITS, bool)
        self.maybe[self.code & np.uint64((1 << _TABLE_BITS) - 1)] = True
        self.sizes = np.unique(self.size)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and item number of each verified occurrence in a sequence of word codes."""
        found = [np.zeros((0, 3), np.int64)]
        for n in self.sizes:
            run = windows(words, int(n))
            at = np.flatnonzero(self.maybe[run & np.uint64((1 << _TABLE_BITS) - 1)])
            lo = np.searchsorted(self.code, run[at], "left")
            many = np.searchsorted(self.code, run[at], "right") - lo
            at = np.repeat(at, many)
            entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(len(at))
            same = self.size[entry] == n
            at, entry = at[same], entry[same]
            if len(at):
                seen = words[at[:, None] + np.arange(n)]
                same = (seen == self.words[entry, :n]).all(axis=1)
                found.append(np.stack([at[same], np.full(same.sum(), n), self.item[entry[same]]], axis=1))
        all_ = np.concatenate(found)
        return all_[:, 0], all_[:, 1], all_[:, 2]


def item_windows(items: DataFrame, n: int) -> DataFrame:
    """Distinct (item, code, words) of all windows; ``words`` are the word codes as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_bytes(part.column("text"))
                start, end, first = word_spans(raw, at, WORDLIKE)
                code = span_codes(raw, start, end)
                ids = part.column("item").to_pylist()
                for i, item in enumerate(ids):
                    own = code[first[i] : first[i + 1]]
                    if item is None or not len(own):
                        continue
                    size = min(n, len(own))
                    run = windows(own, size)
                    run, where = np.unique(run, return_index=True)
                    yield pa.record_batch(
                        {
                            "item": pa.array([item] * len(run), pa.string()),
                            "code": pa.array(run.view(np.int64)),
                            "words": pa.array([own[k : k + size].tobytes() for k in where], pa.binary()),
                        }
                    )

    plain = items.select(F.col("item").cast("string").alias("item"), F.col("text"))
    return plain.mapInArrow(cut, "item string, code long, words binary").distinct()


def _window_set(rows: pa.Table, n: int) -> WindowSet:
    code = rows.column("code").to_numpy().view(np.uint64)
    order = np.argsort(code, kind="stable")
    packed = rows.column("words").to_pylist()
    names, item = np.unique(np.array(rows.column("item").to_pylist(), object).astype(str), return_inverse=True)
    words = np.zeros((len(code), n), np.uint64)
    size = np.zeros(len(code), np.int64)
    for k, i in enumerate(order):
        own = np.frombuffer(packed[i], np.uint64)
        size[k] = len(own)
        words[k, : len(own)] = own
    return WindowSet(code[order], size, words, item[order], [str(x) for x in names])


def _scan(texts: pa.Array, known: WindowSet, before: pa.Array | None) -> pa.Array:
    """Word count, hit runs of words and items of each text, joined with those of earlier blocks."""
    batch = pa.record_batch({"text": texts})
    earlier = before.to_pylist() if before is not None else None
    out, row = [], 0
    for part in slices(batch, "text", SLICE_BYTES):
        raw, at = text_bytes(part.column("text"))
        start, end, first = word_spans(raw, at, WORDLIKE)
        code = span_codes(raw, start, end)
        pos, size, item = known.find(code)
        doc = np.searchsorted(first, pos, side="right") - 1
        inside = pos + size <= first[doc + 1]  # an occurrence ends in the document it began in
        pos, size, item, doc = pos[inside], size[inside], item[inside], doc[inside]
        order = np.argsort(doc, kind="stable")
        pos, size, item, doc = pos[order], size[order], item[order], doc[order]
        edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            a, b = edge[i], edge[i + 1]
            hits: list[dict] = []
            items: set[str] = set()
            if earlier is not None:
                hits, items = earlier[row]["hits"], set(earlier[row]["items"])
            if b > a:
                s = pos[a:b] - first[i]
                hits = _union([*((int(x), int(x + z)) for x, z in zip(s, size[a:b], strict=True)), *((h["start"], h["end"]) for h in hits)])
                items |= {known.names[x] for x in set(item[a:b].tolist())}
            out.append({"n_words": int(first[i + 1] - first[i]), "hits": hits, "items": sorted(items)})
            row += 1
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.array(out, pa.struct([("n_words", pa.int64()), ("hits", pa.list_(span)), ("items", pa.list_(pa.string()))]))


def _scanner(sent, *, first: bool):
    """Arrow function over texts, or over texts and what earlier blocks found."""

    def scan(texts: pa.Array) -> pa.Array:
        return _scan(texts, sent.value, None)

    def scan_more(texts: pa.Array, before: pa.Array) -> pa.Array:
        return _scan(texts, sent.value, before)

    return scan if first else scan_more


def _union(runs: list[tuple[int, int]]) -> list[dict]:
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [{"start": a, "end": b} for a, b in merged]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = 10,
    result: str = "contamination",
    block: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with a struct column ``result``: n_words, hits (runs of word positions, end
    exclusive, in order) and items (ids as strings, sorted as strings).

    The item windows are counted first; each pass over the documents takes at most about ``block``
    of them, so what is shipped is bounded whatever the size of the benchmark.
    """
    cut = stage(item_windows(input_columns(items, item=item_id, text=item_text), n))
    blocks = max(1, -(-cut.count() // block))
    out = docs
    context = docs.sparkSession.sparkContext
    for k in range(blocks):
        part = cut if blocks == 1 else cut.filter(F.pmod(F.xxhash64("code", "item"), F.lit(blocks)) == k)
        scan = F.arrow_udf(_scanner(context.broadcast(_window_set(part.toArrow(), n)), first=k == 0), _RESULT)
        out = out.withColumn(result, scan(F.col(text)) if k == 0 else scan(F.col(text), F.col(result)))
    return out


def contamination_summary(found: DataFrame, doc_id: str = "doc_id", result: str = "contamination") -> DataFrame:
    """Counts and a digest of the items per document."""
    c = F.col(result)
    hit = F.aggregate(c.hits, F.lit(0).cast("long"), lambda t, h: t + h.end - h.start)
    return found.select(
        F.col(doc_id).alias("doc_id"),
        c.n_words.alias("n_words"),
        hit.alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (F.size(c.hits) > 0).alias("contaminated"),
    )


def remove_spans(found: DataFrame, text: str = "text", result: str = "contamination") -> DataFrame:
    """Cut the hit words, and what stands between them, out of the text; the rest stays as it is."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        hits = pa.compute.struct_field(found, "hits").to_pylist()
        raw, at = text_bytes(texts)
        start, end, first = word_spans(raw, at, WORDLIKE)
        out = []
        for i, runs in enumerate(hits):
            if not texts[i].is_valid:
                out.append(None)
                continue
            kept, last = [], at[i]
            for h in runs or []:
                kept.append(raw[last : start[first[i] + h["start"]]].tobytes())
                last = end[first[i] + h["end"] - 1]
            kept.append(raw[last : at[i + 1]].tobytes())
            out.append(b"".join(kept).decode())
        return pa.array(out, pa.string())

    return found.withColumn(text, cut(F.col(text), F.col(result)))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 10
) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    name = free_name(docs, "contamination")
    found = find_contamination(docs, items, text=text, item_id=item_id, item_text=item_text, n=n, result=name)
    return found.filter(F.size(F.col(name).hits) == 0).drop(name)

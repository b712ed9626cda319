"""Token counts that follow edits: only what an edit touches is encoded again.

A document's state is its text's cut into short runs of whole pieces (leaves) with the bytes and
tokens of each. Applying edits builds a segment tree over the leaves, finds the touched leaves by
descent, encodes their new text with one leaf of context on either side, and updates the sums on
the paths to the root. Cuts stand between two visible characters that no edit inside the context
touches, so the new counts equal those of encoding the whole edited text.

Edits are (start, end, text) in code points of the text before the edits, applied together. An edit
that overlaps an earlier one (by start, then end) or lies outside the text is left out; ``start ==
end`` inserts. Null texts are empty. States are found by id and text, so repeated rows, repeated
ids and null ids keep their own counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.pieces import PieceEncoder, encoder
from fleetcast.llm.words import slices, text_bytes
from fleetcast.session import stage

#: bytes of a leaf, about
LEAF_BYTES = 128

_STATE = "struct<n_tokens:bigint,sizes:binary,tokens:binary>"
_RECOUNT = "struct<n_tokens:bigint,n_edits:bigint,bytes_encoded:bigint>"


class SumTree:
    """Segment tree of leaf sizes and token counts: point update, total, descent by size."""

    def __init__(self, sizes: np.ndarray, tokens: np.ndarray):
        self.n = len(sizes)
        self.width = 1 << max(0, (max(1, self.n) - 1).bit_length())
        self.size = np.zeros(2 * self.width, np.int64)
        self.token = np.zeros(2 * self.width, np.int64)
        self.size[self.width : self.width + self.n] = sizes
        self.token[self.width : self.width + self.n] = tokens
        level = self.width
        while level > 1:
            for a in (self.size, self.token):
                a[level // 2 : level] = a[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    def total(self) -> int:
        return int(self.token[1])

    def find(self, at: int) -> int:
        """Leaf that holds byte ``at`` (the last one for a place at or after the end)."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.size[node]:
                at -= int(self.size[node])
                node += 1
        return min(node - self.width, max(0, self.n - 1))

    def start(self, leaf: int) -> int:
        node, before = leaf + self.width, 0
        while node > 1:
            if node & 1:
                before += int(self.size[node - 1])
            node //= 2
        return before

    def put(self, leaf: int, size: int, tokens: int) -> None:
        node = leaf + self.width
        grown, more = size - int(self.size[node]), tokens - int(self.token[node])
        while node:
            self.size[node] += grown
            self.token[node] += more
            node //= 2


def leaves(words: PieceEncoder, raw: np.ndarray, at: np.ndarray, leaf_bytes: int = LEAF_BYTES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sizes and token counts of the leaves of each row."""
    start, slot = words.pieces(raw, at)
    total = np.concatenate([[0], np.cumsum(words.counts(slot))])
    first = np.searchsorted(start, at)
    out = []
    for i in range(len(at) - 1):
        own = start[first[i] : first[i + 1]]
        # a leaf is the pieces that begin in the same stretch of the row
        new = np.flatnonzero(np.diff((own - at[i]) // leaf_bytes, prepend=-1)) if len(own) else np.zeros(0, np.int64)
        edge = np.append(own[new], at[i + 1])
        count = np.append(total[first[i] + new], total[first[i + 1]])
        out.append((np.diff(edge), np.diff(count)))
    return out


def recount(words: PieceEncoder, raw: bytes, sizes: np.ndarray, tokens: np.ndarray, edits: list[tuple[int, int, bytes]]) -> tuple[int, int]:
    """Token count after ``edits`` (byte places, in order, apart) and the bytes that were encoded again."""
    if not edits:
        return int(tokens.sum()), 0
    if not len(sizes):
        return len(words.direct([b"".join(e[2] for e in edits).decode()])[0]), sum(len(e[2]) for e in edits)
    tree = SumTree(sizes, tokens)
    groups: list[tuple[int, int, list]] = []  # touched leaves with context, and the edits in them
    for a, b, new in edits:
        lo = max(0, tree.find(a) - (1 if a == len(raw) or tree.start(tree.find(a)) == a else 0) - 1)
        hi = min(tree.n - 1, tree.find(max(a, b)) + 1)
        if groups and lo <= groups[-1][1]:
            groups[-1] = (groups[-1][0], max(hi, groups[-1][1]), [*groups[-1][2], (a, b, new)])
        else:
            groups.append((lo, hi, [(a, b, new)]))
    encoded = 0
    limits = [(tree.start(lo), tree.start(hi) + int(tree.size[hi + tree.width])) for lo, hi, _ in groups]
    for (lo, hi, own), (begin, end) in zip(groups, limits, strict=True):
        parts, last = [], begin
        for a, b, new in own:
            parts += [raw[last:a], new]
            last = b
        region = b"".join([*parts, raw[last:end]])
        encoded += len(region)
        count = len(words.direct([region.decode()])[0])
        tree.put(lo, len(region), count)
        for leaf in range(lo + 1, hi + 1):
            tree.put(leaf, 0, 0)
    return tree.total(), encoded


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", result: str = "state") -> DataFrame:
    """``docs`` with the state of each text: n_tokens, and the leaves as packed unsigned 32-bit numbers."""

    def state(texts: pa.Array) -> pa.Array:
        words, out = encoder(vocabulary), []
        for part in slices(pa.record_batch({"text": texts}), "text"):
            for sizes, tokens in leaves(words, *text_bytes(part.column("text"))):
                out.append({"n_tokens": int(tokens.sum()), "sizes": sizes.astype("<u4").tobytes(), "tokens": tokens.astype("<u4").tobytes()})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("sizes", pa.binary()), ("tokens", pa.binary())]))

    return docs.withColumn(result, F.arrow_udf(_typed(state), _STATE)(F.col(text)))


def _typed(fn):
    fn.__annotations__ = dict.fromkeys([k for k in fn.__annotations__ if k != "return"], pa.Array) | {"return": pa.Array}
    return fn


def clean_edits(edits: list[dict] | None, n_chars: int) -> list[tuple[int, int, str]]:
    """Edits in order, without those that overlap an earlier one or leave the text."""
    out: list[tuple[int, int, str]] = []
    for e in sorted(edits or [], key=lambda e: (e["start"], e["end"])):
        if 0 <= e["start"] <= e["end"] <= n_chars and (not out or e["start"] >= out[-1][1]):
            out.append((e["start"], e["end"], e["text"] or ""))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    kept, last = [], 0
    for a, b, new in edits:
        kept += [text[last:a], new]
        last = b
    return "".join([*kept, text[last:]])


def recount_edited(docs: DataFrame, states: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", edits: str = "edits") -> DataFrame:
    """Counts after edits, one row per row of ``docs``: doc_id, n_tokens_before, n_tokens, n_edits, bytes_encoded.

    ``states`` has doc_id, text_code and state, as ``state_table`` makes it. Only rows with edits
    send their text to the join; the others take their count from the state.
    """
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_code"), F.col(text).alias("_text"), F.col(edits).alias("_edits")
    )
    edited = F.coalesce(F.size("_edits") > 0, F.lit(False))

    def again(texts: pa.Array, changes: pa.Array, state: pa.Array) -> pa.Array:
        words, out = encoder(vocabulary), []
        for t, e, s in zip(texts, changes.to_pylist(), state, strict=True):
            chars = t.as_py() or ""
            kept = clean_edits(e, len(chars))
            raw = chars.encode()
            width = np.cumsum([0, *map(len, map(str.encode, chars))]) if not chars.isascii() else None
            place = (lambda k: k) if width is None else (lambda k, width=width: int(width[k]))
            packed = s.as_py()
            sizes, tokens = (np.frombuffer(packed[k], "<u4").astype(np.int64) for k in ("sizes", "tokens"))
            n, work = recount(words, raw, sizes, tokens, [(place(a), place(b), new.encode()) for a, b, new in kept])
            out.append({"n_tokens": n, "n_edits": len(kept), "bytes_encoded": work})
        return pa.array(out, pa.struct([("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("bytes_encoded", pa.int64())]))

    lone = states.dropDuplicates(["doc_id", "text_code"])

    def matched(rows: DataFrame) -> DataFrame:
        same = rows.doc_id.eqNullSafe(F.col("_sid")) & rows.text_code.eqNullSafe(F.col("_scode"))
        return rows.join(lone.select(F.col("doc_id").alias("_sid"), F.col("text_code").alias("_scode"), "state"), same)

    changed = matched(keyed.filter(edited)).withColumn("_r", F.arrow_udf(_typed(again), _RECOUNT)("_text", "_edits", "state"))
    columns = ["doc_id", F.col("state.n_tokens").alias("n_tokens_before")]
    changed = changed.select(*columns, *[F.col(f"_r.{c}").alias(c) for c in ("n_tokens", "n_edits", "bytes_encoded")])
    zero = F.lit(0).cast("long")
    same = matched(keyed.filter(~edited).drop("_text", "_edits")).select(
        *columns, F.col("state.n_tokens").alias("n_tokens"), zero.alias("n_edits"), zero.alias("bytes_encoded")
    )
    return changed.unionByName(same)


def state_table(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """States of all documents, written to the shared folder."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_code"), F.col(text).alias("_text"))
    return stage(count_tokens(keyed, vocabulary, text="_text").drop("_text"))


def redactions(text: Column, pattern: str, replacement: str) -> Column:
    """Edits that replace each match of a regular expression (array of start, end, text)."""
    import re

    found = re.compile(pattern)

    def find(texts: pa.Array) -> pa.Array:
        rows = [[{"start": m.start(), "end": m.end(), "text": replacement} for m in found.finditer(t.as_py() or "")] for t in texts]
        return pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])))

    return F.arrow_udf(_typed(find), "array<struct<start:bigint,end:bigint,text:string>>")(text)

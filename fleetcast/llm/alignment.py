"""Alignment of two tokenizers over a corpus, and how often their ids meet.

Tokenizer A (byte-level BPE) reads a space and the text, tokenizer B (a piece model that puts the space
itself) reads the text. Token bytes give byte offsets; where tokens of both end, the text is cut into
groups. A link is a pair of token occurrences whose byte ranges overlap; the count of an id pair is the
number of links of the whole corpus that hold it.

Neither vocabulary has an entry that runs over a space between two visible characters, so a text falls
into parts there, and the parts repeat a lot. In a task, new parts are aligned in Arrow: token lists are
flattened with their parent indices, byte lengths summed up per parent, ends of A and B hash-joined on
(parent, end); filled backwards, the joined rows are the links. A block of texts (32 MB) then counts its
id pairs with ``Table.group_by``; Spark adds the partial counts up and sends each block the
counts of its own pairs back, so nothing that grows with the corpus is shipped or held by one task.

Null and empty texts, and texts whose token bytes are not the space and the text (a piece model may
normalise), have no tokens: zeros and an empty digest. Every row gives a row, repeated rows and null ids
too; an empty table gives none; other columns are ignored. Marker strings in a text are ordinary text.
Parts are told apart by 64-bit codes of their bytes. A part without any such space (a very long text
may be one) is aligned as a whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetcast.llm.code_index import CodeIndex, Grown, gather
from fleetcast.llm.frames import input_columns, measured_join
from fleetcast.llm.pieces import cut_points
from fleetcast.llm.words import give_back, slices, span_codes, text_bytes, tidied
from fleetcast.session import stage

#: text of a block; its parts, pairs and counts are one task's work
BLOCK_BYTES = 16 << 20
#: links that a worker remembers before it starts over with the next block
REMEMBERED_LINKS = 1 << 23
_AT_ONCE = 1 << 12
_SLICE = 1 << 20
_ROWS = 1 << 12

_DOC, _PARTS, _PAIR = 0, 1, 2


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Fixed rule: printable characters of Latin-1 stand for themselves, the others are 256 and up in order.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def spelled_a(path: str) -> tuple[Tokenizer, list[bytes]]:
    """Tokenizer and the bytes of each of its ids."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel work
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # marker strings in a text are ordinary text
    alphabet, entries = byte_level_alphabet(), made.get_vocab()
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        out[i] = bytes(alphabet[c] for c in entry)
    return made, out


def spelled_b(path: str) -> tuple[sentencepiece.SentencePieceProcessor, list[bytes]]:
    """Piece model and the bytes of each of its ids."""
    made = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(made.get_piece_size()):
        piece = made.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if made.is_byte(i) else piece.replace("▁", " ").encode())
    return made, out


class Tokens:
    """Token lists of some texts, flattened: parent text, byte end inside it, id."""

    def __init__(self, ids: list[list[int]], spelled: pa.Array, name: str):
        lists = pa.array(ids, pa.list_(pa.int32()))
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        own = spelled.take(flat)
        total = pc.cumulative_sum(pc.binary_length(own).cast(pa.int64()))
        before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets.slice(0, len(ids)))
        self.count = pc.list_value_length(lists).to_numpy().astype(np.int64)
        self.text = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, own), b"")
        self.table = pa.table({"parent": parent, "end": pc.subtract(total, before.take(parent)), name: flat})


def align(texts: list[str], a: list[list[int]], b: list[list[int]], spelled: tuple[pa.Array, pa.Array]):
    """Per text: whether it is valid, its groups, links and digest text; and the links as (A id << 32 | B id) in order."""
    n = len(texts)
    left, right = Tokens(a, spelled[0], "a"), Tokens(b, spelled[1], "b")
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    valid = pc.and_(pc.equal(left.text, whole), pc.equal(right.text, whole))
    sides = [t.table.filter(valid.take(t.table["parent"])) for t in (left, right)]
    ends = sides[0].join(sides[1], ["parent", "end"], join_type="full outer", use_threads=False).sort_by([("parent", "ascending"), ("end", "ascending")]).combine_chunks()
    own = {s: pc.is_valid(ends[s]).to_numpy() for s in "ab"}
    # the token over the stretch before an end is the next of its side to end; texts end with both
    ids = {s: np.asarray(pc.fill_null_backward(ends[s].combine_chunks()), np.int64) for s in "ab"}
    parent = np.asarray(ends["parent"], np.int64)
    shared = own["a"] & own["b"]
    group = np.cumsum(shared) - shared
    # digest text: ids of A, then of B, group after group
    texts_of, order, of = [], [], []
    for side, closing in (("a", "|"), ("b", ";")):
        at = np.flatnonzero(own[side])
        mark = pa.array(np.where(shared[at], closing, ","), pa.string())
        texts_of.append(pc.binary_join_element_wise(pa.array(ids[side][at]).cast(pa.string()), mark, ""))
        order.append(group[at] * 2 + (side == "b"))
        of.append(parent[at])
    by_group = np.argsort(np.concatenate(order), kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(of), minlength=n))]).astype(np.int32)
    digest = pc.binary_join(pa.ListArray.from_arrays(offsets, pa.concat_arrays(texts_of).take(pa.array(by_group))), "")
    links = np.bincount(parent, minlength=n)
    groups = np.bincount(parent[shared], minlength=n)
    return np.asarray(valid), left.count, right.count, groups, links, digest, (ids["a"] << 32) | ids["b"]


class Aligner:
    """Aligned parts of texts, remembered by a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, spelled = spelled_a(path_a)
        self.b, pieces = spelled_b(path_b)
        self.spelled = pa.array(spelled, pa.binary()), pa.array(pieces, pa.binary())
        self.forget()

    def forget(self) -> None:
        self.index = CodeIndex()
        self.valid = Grown(bool)
        self.tokens_a, self.tokens_b, self.groups, self.links = (Grown(np.int64) for _ in range(4))
        self.link_at, self.link = Grown(np.int64, (0,)), Grown(np.int64)
        self.text_at, self.text = Grown(np.int64, (0,)), Grown(np.uint8)

    def _learn(self, texts: list[str]) -> None:
        for k in range(0, len(texts), _AT_ONCE):
            some = texts[k : k + _AT_ONCE]
            a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in some], add_special_tokens=False)]
            valid, n_a, n_b, groups, links, digest, pairs = align(some, a, self.b.encode(some, num_threads=1), self.spelled)
            for kept, new in ((self.valid, valid), (self.tokens_a, n_a), (self.tokens_b, n_b), (self.groups, groups), (self.links, links), (self.link, pairs)):
                kept.append(new)
            self.link_at.append(self.link_at.values[-1] + np.cumsum(links))
            size = pc.binary_length(digest).to_numpy().astype(np.int64)
            self.text_at.append(self.text_at.values[-1] + np.cumsum(size))
            self.text.append(text_bytes(digest)[0])

    def parts(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the parts of the rows in order, and where each row begins (n + 1 values)."""
        rows = at[:-1][np.diff(at) > 0]
        if not len(rows):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        cut = cut_points(raw)
        edge = np.zeros(len(raw) + 1, bool)
        edge[at] = True
        cut = cut[~edge[cut] & ~edge[cut + 1]]  # a space at either end of a row cuts nothing
        start = np.sort(np.concatenate([rows, cut + 1]))
        end = np.sort(np.concatenate([at[1:][np.diff(at) > 0], cut]))
        code = span_codes(raw, start, end, fold=False)
        slot = self.index.find(code)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, first, which = np.unique(code[miss], return_index=True, return_inverse=True)
            seen = miss[first]
            given = self.index.add(new)
            self._learn([raw[s:e].tobytes().decode() for s, e in zip(start[seen].tolist(), end[seen].tolist(), strict=True)])
            slot[miss] = given[which]
        return slot, np.searchsorted(start, at)

    def digests(self, slot: np.ndarray, first: np.ndarray, kept: np.ndarray) -> list[str]:
        """Hex digest of each kept row's groups, '' for the others."""
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.valid.n, [None, pa.py_buffer(self.text_at.values), pa.py_buffer(self.text.values)])
        raw, at = text_bytes(held.take(pa.array(slot)))
        return [hashlib.sha256(raw[a : b - 1]).hexdigest() if ok else "" for a, b, ok in zip(at[first[:-1]], at[first[1:]], kept, strict=True)]


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes; small numbers leave planes of zeros, which compress away."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, row by row, and the row limits."""
    raw, at = text_bytes(planes)
    at = at // 4
    n = np.diff(at)
    place = gather(at[:-1] * 4, n)
    out = np.zeros(at[-1], np.int64)
    for k in range(4):
        out |= raw[place + np.repeat(k * n, n)].astype(np.int64) << (8 * k)
    return out, at


class _Block:
    """Texts of a block as lists of parts; ``rows`` gives them with the block's pair counts."""

    def __init__(self, words: Aligner, number: int):
        self.words, self.number, self.size = words, number, 0
        self.docs: list[dict] = []

    def add(self, part: pa.RecordBatch) -> None:
        w = self.words
        raw, at = text_bytes(part.column("text"))
        slot, first = w.parts(raw, at)
        many = np.diff(first)
        total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[slot])])[first])
        kept = (many > 0) & (total(~w.valid.values) == 0)
        found = {name: total(v.values) * kept for name, v in (("n_a", w.tokens_a), ("n_b", w.tokens_b), ("n_groups", w.groups), ("n_links", w.links))}
        sha = w.digests(slot, first, kept)
        self.docs.append({"doc_id": part.column("doc_id"), "sha": sha, "slot": slot[np.repeat(kept, many)], "many": many * kept, **found})
        self.size += len(raw)

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        w = self.words

        def made(size: int, kind: int, **columns) -> pa.RecordBatch:
            full = {"block": pa.array(np.full(size, self.number)), "kind": pa.array(np.full(size, kind, np.int8)), **columns}
            return pa.record_batch([full[f.name].cast(f.type) if f.name in full else pa.nulls(size, f.type) for f in schema], schema=schema)

        slots = np.concatenate([d["slot"] for d in self.docs])
        used = np.zeros(w.valid.n, bool)
        used[slots] = True
        known = np.flatnonzero(used)
        local = np.cumsum(used) - 1
        times = np.bincount(local[slots], minlength=len(known))
        frequent = np.argsort(-times, kind="stable")  # frequent parts get small numbers
        place = np.empty(len(known), np.int64)
        place[frequent] = np.arange(len(known))
        known, times = known[frequent], times[frequent]
        number = place[local[slots]]
        # partial counts of the id pairs
        links = w.links.values[known]
        pair = w.link.values[gather(w.link_at.values[known], links)]
        counts = pa.table({"pair": pair, "n": np.repeat(times, links)}).group_by("pair").aggregate([("n", "sum")]).sort_by("pair").combine_chunks()
        code, n = np.asarray(counts["pair"], np.int64), np.asarray(counts["n_sum"], np.int64)
        for k in range(0, len(code), 1 << 16):
            some = code[k : k + (1 << 16)]
            yield made(len(some), _PAIR, a=pa.array(some >> 32), b=pa.array(some & 0xFFFFFFFF), n=pa.array(n[k : k + len(some)]), place=pa.array(np.arange(k, k + len(some))))
        yield made(1, _PARTS, items=pa.array([_planes(links)], pa.binary()), pairs=pa.array([_planes(np.searchsorted(code, pair))], pa.binary()))
        at = 0
        for d in self.docs:
            ends = at + np.cumsum(d["many"])
            starts = ends - d["many"]
            at = int(ends[-1]) if len(ends) else at
            for k in range(0, len(ends), _ROWS):
                items = [_planes(number[s:e]) for s, e in zip(starts[k : k + _ROWS], ends[k : k + _ROWS], strict=True)]
                cut = {c: pa.array(d[c][k : k + _ROWS]) for c in ("n_a", "n_b", "n_groups", "n_links")}
                yield made(len(items), _DOC, doc_id=d["doc_id"].slice(k, len(items)), sha=pa.array(d["sha"][k : k + _ROWS]), items=pa.array(items, pa.binary()), **cut)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, *, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose id pair is the most frequent of its B id in the corpus (ties
    included), ``count_sum`` adds the counts of all links up.
    """
    plain = input_columns(docs, doc_id=doc_id, text=text)
    arrow = "block long, kind tinyint, n_a long, n_b long, n_groups long, n_links long, sha string, items binary, pairs binary, a int, b int, n long, place int"
    id_type = plain.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = aligner(path_a, path_b)
        block, number, schema = None, TaskContext.get().partitionId() << 32, None
        for batch in batches:
            if schema is None:
                types = {"long": pa.int64(), "tinyint": pa.int8(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
                schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), *[(c.split()[0], types[c.split()[1]]) for c in arrow.split(", ")]])
            for part in slices(batch, "text", _SLICE):
                if block is None:
                    if words.link.n > REMEMBERED_LINKS:
                        words.forget()
                    block, number = _Block(words, number), number + 1
                block.add(part)
                if block.size >= block_bytes:
                    yield from block.rows(schema)
                    block = None
                    give_back()
        if block is not None:
            yield from block.rows(schema)
            block = None
        give_back()

    rows = stage(plain.mapInArrow(blocks, f"doc_id {id_type}, {arrow}"))
    pairs = rows.filter(F.col("kind") == _PAIR).select("block", "place", "a", "b", "n")
    totals = stage(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")))
    # one row per id of a vocabulary
    best = totals.groupBy("b").agg(F.max("total").alias("best"))
    judged = totals.join(F.broadcast(best), "b").select("a", "b", "total", (F.col("total") == F.col("best")).alias("top"))
    counted = measured_join(pairs, stage(judged), ["a", "b"], "inner").select(F.col("block").alias("of"), "place", "total", "top")

    def settle(mine: pa.Table, counts: pa.Table) -> pa.Table:
        """Counts of pairs, then of parts, then of documents."""
        total, top = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
        place = np.asarray(counts["place"], np.int64)
        total[place], top[place] = np.asarray(counts["total"], np.int64), np.asarray(counts["top"].cast(pa.int64()), np.int64)
        kinds = np.asarray(mine["kind"])
        inside = mine.filter(pa.array(kinds == _PARTS))
        links, _ = _numbers(inside["items"].combine_chunks())
        pair, _ = _numbers(inside["pairs"].combine_chunks())
        limits = np.concatenate([[0], np.cumsum(links)])
        of_part = {name: np.diff(np.concatenate([[0], np.cumsum(v[pair])])[limits]) for name, v in (("n_best", top), ("count_sum", total))}
        docs = mine.filter(pa.array(kinds == _DOC))
        parts, at = _numbers(docs["items"].combine_chunks())
        sums = {name: pa.array(np.diff(np.concatenate([[0], np.cumsum(v[parts])])[at]), pa.int64()) for name, v in of_part.items()}
        return pa.table({**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, **sums, "groups_sha256": docs["sha"]})

    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = rows.filter(F.col("kind") != _PAIR).select("block", "kind", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "items", "pairs")
    return texts.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(lambda mine, counts: tidied(settle(mine, counts)), schema)

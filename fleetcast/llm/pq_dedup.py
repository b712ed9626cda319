"""Near-duplicate vectors by product quantisation with inverted lists and exact rerank.

A coarse quantiser deals unit vectors to inverted lists; residuals get one code per subspace. Partners
are at most r = sqrt(2 - 2 limit) apart, so if they are in different lists, one of them is within r / 2 of
the plane between the two centroids. A vector probes every list to whose plane it is that near: each
pair is met from one side at least, whatever the number of lists. In a list, the products of the queries
with the members as their codes tell them give approximate cosines; with the member's own coding error
added these never fall below the true cosine. Pairs over the limit are compared in double precision. No
link is lost; ``probes`` caps the lists of a vector where speed counts more.

Neighbouring lists are packed into blocks, large lists cut over several. A vector is sent once to each
block that it probes or that probes its list, not to each list, and two blocks that meet are one tile.
Blocks grow with the table up to ``BLOCK_BYTES``, so up to ``BLOCKS`` of those the rows sent are in
proportion to the vectors. Counts are added up and links turned into spanning forests inside the tasks,
so pairs are never written. Equal vectors are one class and are compared once. The quantisers are fitted
on at most ``SAMPLE`` vectors; all are indexed.

A vector that is null, empty, zero or has null or non-finite components links with nothing; vectors
of different lengths never link. Rows with a null id are returned unlinked with a null component.
Repeated ids and rows count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.components import components, forest
from fleetcast.llm.frames import input_columns
from fleetcast.session import stage

LIMIT = 0.9
#: vectors that the quantisers are fitted on at most
SAMPLE = 1 << 16
LIST_VECTORS = 256
MOST_LISTS = 1 << 12
SUBSPACES = 16
CODEWORDS = 256
ROUNDS = 8
#: blocks that the vectors are cut into at least, if a block has no fewer than ``BLOCK_VECTORS``
BLOCKS = 8
BLOCK_VECTORS = 1 << 10
#: vectors of a block at most, in single precision
BLOCK_BYTES = 1 << 24
#: members compared at once, and pairs
MEMBERS = 1 << 11
PAIRS = 1 << 22

_SLACK = 1e-5  # of single precision
_CODED = "class long, copies long, home int, vector binary, code binary, error float, reach binary"
_DEALT = "i int, j int, first boolean, " + _CODED
_ASKED = "list int, mask long"
_FOUND = "class long, links long, root long"


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, *, unit: bool) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one moves to the vector that is served worst."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        worst = np.empty(len(x), np.float32)
        for a in range(0, len(x), 8192):
            part = x[a : a + 8192]
            gap = (centre * centre).sum(axis=1)[None, :] - 2 * part @ centre.T
            near[a : a + 8192] = gap.argmin(axis=1)
            worst[a : a + 8192] = gap.min(axis=1) + (part * part).sum(axis=1)
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(len(centre)))
        many = np.bincount(near, minlength=len(centre))
        full = many > 0
        centre[full] = np.add.reduceat(x[order], at[full], axis=0) / many[full, None]
        empty = np.flatnonzero(~full)
        centre[empty] = x[np.argsort(-worst)[: len(empty)]]
        if unit:
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def _neighbours(centres: np.ndarray) -> np.ndarray:
    """An order of the centroids in which near ones are mostly near: halves along the widest direction, again and again."""

    def halves(some: np.ndarray) -> list[np.ndarray]:
        if len(some) < 3:
            return [some]
        own = centres[some] - centres[some].mean(axis=0)
        wide = np.linalg.eigh(own.T @ own)[1][:, -1]
        some = some[np.argsort(own @ wide, kind="stable")]
        return halves(some[: len(some) // 2]) + halves(some[len(some) // 2 :])

    return np.concatenate(halves(np.arange(len(centres))))


@dataclass
class Quantiser:
    """Centroids (lists, d) and codewords (subspaces, codewords, width) of the residuals."""

    centres: np.ndarray
    words: np.ndarray

    @classmethod
    def fit(cls, unit: np.ndarray, lists: int) -> Quantiser:
        unit = unit.astype(np.float32)
        centres = _kmeans(unit, lists, ROUNDS, 1, unit=True)
        centres = centres[_neighbours(centres)]
        residual = unit - centres[(unit @ centres.T).argmax(axis=1)]
        cut = cls._cut(residual)
        words = [_kmeans(np.ascontiguousarray(cut[:, m]), CODEWORDS, ROUNDS, 2 + m, unit=False) for m in range(cut.shape[1])]
        return cls(centres, np.stack(words))

    @staticmethod
    def _cut(x: np.ndarray) -> np.ndarray:
        """Rows as (subspaces, width); the last subspace is filled up with zeros."""
        m = min(SUBSPACES, x.shape[1])
        width = -(-x.shape[1] // m)
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def reach(self, unit: np.ndarray, limit: float, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each vector (nearest centroid, ties by number), and for each list whether it is probed."""
        cosine = unit.astype(np.float32) @ self.centres.T
        home = cosine.argmax(axis=1).astype(np.int32)
        own = self.centres[home]
        square = (self.centres * self.centres).sum(axis=1)
        apart = np.sqrt(np.maximum(square[home][:, None] + square[None, :] - 2 * own @ self.centres.T, 0) + 1e-6)
        near = cosine[np.arange(len(unit)), home][:, None] - cosine <= np.sqrt((1 - limit) / 2) * apart + _SLACK
        if probes is not None and probes < len(self.centres):
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :probes]
            kept = np.zeros_like(near)
            np.put_along_axis(kept, best, True, axis=1)
            near &= kept
        near[np.arange(len(unit)), home] = True
        return home, near

    def encode(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and the length of what they leave out."""
        residual = self._cut(unit - self.centres[home].astype(np.float64))
        code = np.empty(residual.shape[:2], np.uint8)
        error = np.zeros(len(unit))
        for m in range(residual.shape[1]):
            part, words = residual[:, m], self.words[m]
            code[:, m] = ((words * words).sum(axis=1)[None, :] - 2 * part.astype(np.float32) @ words.T).argmin(axis=1)
            error += ((part - words[code[:, m]]) ** 2).sum(axis=1)
        return code, np.sqrt(error).astype(np.float32)

    def decode(self, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Vectors as their lists and codes tell them."""
        parts = self.words[np.arange(codes.shape[1])[None, :], codes]
        return self.centres[home] + parts.reshape(len(codes), -1)[:, : self.centres.shape[1]]


def _clean(vectors: DataFrame) -> DataFrame:
    """Usable vectors of one row per class: class, copies, dimension, v (doubles)."""
    v = F.col("v")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.withColumn("sound", F.coalesce(sound, F.lit(False)))


def _units(flat: np.ndarray, d: int) -> np.ndarray:
    """Unit vectors in double precision."""
    flat = flat.astype(np.float64).reshape(-1, d)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # far from over- and underflow
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of bytes of one length as a matrix."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


@dataclass
class Blocks:
    """Lists packed into blocks in their order; a list of more than a block is cut into parts, dealt by class."""

    parts: np.ndarray  # of a list
    start: np.ndarray  # first part of a list
    block: np.ndarray  # of a part
    low: np.ndarray  # first list of a block
    high: np.ndarray  # the list after its last

    @classmethod
    def cut(cls, sizes: np.ndarray, most: int) -> Blocks:
        parts = np.maximum(1, -(-sizes // most))
        each = np.repeat(-(-sizes // parts), parts)
        lists = np.repeat(np.arange(len(sizes)), parts)
        block = np.zeros(len(each), np.int64)
        held = 0
        for k, size in enumerate(each):
            full = held and held + size > most
            block[k] = block[k - 1] + full if k else 0
            held = size if full else held + size
        edge = np.flatnonzero(np.diff(block, prepend=-1))
        return cls(parts, np.cumsum(parts) - parts, block, lists[edge], lists[np.append(edge[1:], len(block)) - 1] + 1)

    def of(self, home: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return self.block[self.start[home] + (classes.astype(np.uint64) % self.parts[home].astype(np.uint64)).astype(np.int64)]

    def group(self) -> np.ndarray:
        """One of 64 groups of neighbouring blocks, for each block."""
        return np.arange(len(self.low)) * min(64, len(self.low)) // len(self.low)


class _Side:
    """The vectors of one block in a tile, in the order of their lists, and what they probe in the other block."""

    def __init__(self, table: pa.Table, quantiser: Quantiser, d: int, kind: type, low: int, other: tuple[int, int]):
        table = table.sort_by("home").combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        self.id, self.copies, self.home = (column(c).to_numpy() for c in ("class", "copies", "home"))
        self.raw = _unpacked(column("vector"), kind)
        self.near = np.unpackbits(_unpacked(column("reach"), np.uint8), axis=1, count=other[1] - other[0]).astype(bool)
        self.low = low
        self.links = np.zeros(len(self.id), np.int64)
        code, error = _unpacked(column("code"), np.uint8), column("error").to_numpy()
        # one more column adds the error to the product
        self.single, self.told = np.ones((len(self.id), d + 1), np.float32), np.empty((len(self.id), d + 1), np.float32)
        for a in range(0, len(self.id), 4096):
            b = slice(a, a + 4096)
            self.single[b, :d] = _units(self.raw[b], d)
            self.told[b, :d], self.told[b, d] = quantiser.decode(self.home[b], code[b]), error[b]


def _meet(q: _Side, x: _Side, d: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Adds up the links of the queries in the lists that they probe; yields forests of the links."""
    lists, at = np.unique(x.home, return_index=True)
    for k, start, end in zip(lists, at, np.append(at[1:], len(x.home)), strict=True):
        rows = np.flatnonzero(q.near[:, k - x.low])
        for a in range(start, end, MEMBERS):
            told = x.told[a : min(a + MEMBERS, end)].T
            step = max(1, PAIRS // told.shape[1])
            for some in (rows[r : r + step] for r in range(0, len(rows), step)):
                maybe = q.single[some] @ told >= limit - _SLACK
                i = np.flatnonzero(maybe.any(axis=1))
                if not len(i):
                    continue
                j = np.flatnonzero(maybe[i].any(axis=0))
                maybe, i, j = maybe[np.ix_(i, j)], some[i], a + j
                cosine = _units(q.raw[i], d) @ _units(x.raw[j], d).T
                linked = maybe & (cosine >= limit) & (q.id[i][:, None] != x.id[j][None, :])
                if not linked.any():
                    continue
                q.links[i] += linked @ x.copies[j]
                # a member that does not probe the query's list would never learn of the link
                away = linked & ~x.near[j][:, q.home[i] - q.low].T
                x.links[j] += q.copies[i] @ away
                yield forest(linked, q.id[i], x.id[j])


def _tile(table: pa.Table, quantiser: Quantiser, blocks: Blocks, d: int, kind: type, limit: float) -> pa.Table:
    """Links between the vectors of two blocks, or inside one: counts, and a forest."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    span = lambda b: (int(blocks.low[b]), int(blocks.high[b]))
    first = table.column("first")
    sides = [_Side(table.filter(first), quantiser, d, kind, span(i)[0], span(j))]
    if i != j:
        sides.append(_Side(table.filter(pc.invert(first)), quantiser, d, kind, span(j)[0], span(i)))
    pairs = [(sides[0], sides[0])] if i == j else [(sides[0], sides[1]), (sides[1], sides[0])]
    trees = [tree for q, x in pairs for tree in _meet(q, x, d, limit)]
    told = [(s.id[s.links > 0], s.links[s.links > 0]) for s in sides]
    none = np.zeros(0, np.int64)
    ids, links = (np.concatenate([none, *(t[k] for t in told)]) for k in (0, 1))
    node, root = (np.concatenate([none, *(t[k] for t in trees)]) for k in (0, 1))
    columns = np.concatenate([ids, node]), np.concatenate([links, np.zeros(len(node), np.int64)]), np.concatenate([ids, root])
    return pa.table(dict(zip(("class", "links", "root"), map(pa.array, columns), strict=True)))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, rows) for a in range(0, batch.num_rows, rows))


def _coded(classes: DataFrame, sent: Broadcast, d: int, kind: type, limit: float, probes: int | None) -> DataFrame:
    """Each vector once: its list, code and coding error, and the lists that it probes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in _slices(batches):
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, d)
            unit = _units(flat, d)
            home, near = fitted.reach(unit, limit, probes)
            codes, errors = fitted.encode(unit, home)
            columns = [batch.column("class"), batch.column("copies"), pa.array(home), _packed(flat), _packed(codes), pa.array(errors), _packed(np.packbits(near, axis=1))]
            yield pa.record_batch(columns, [c.split()[0] for c in _CODED.split(", ")])

    return stage(classes.select("class", "copies", "v").mapInArrow(code, _CODED))


def _dealt(coded: DataFrame, lists: int, most: int) -> tuple[DataFrame, Blocks]:
    """Rows of all tiles (pairs of blocks i <= j): a vector for each block that it probes or that probes its list."""
    sizes = np.zeros(lists, np.int64)
    for home, n in coded.groupBy("home").count().collect():  # at most MOST_LISTS rows
        sizes[home] = n
    blocks = Blocks.cut(sizes, most)
    group = blocks.group()

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        home = batch.column("home").to_numpy()
        near = np.unpackbits(_unpacked(batch.column("reach"), np.uint8), axis=1, count=lists).astype(bool)
        return home, near, blocks.of(home, batch.column("class").to_numpy())

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(lists, np.int64)
        for batch in _slices(batches):
            _, near, own = read(batch)
            for g in np.unique(group[own]):
                mask[near[group[own] == g].any(axis=0)] |= np.int64(1) << g
        yield pa.record_batch({"list": pa.array(np.arange(lists, dtype=np.int32)), "mask": pa.array(mask)})

    masks = np.zeros(lists, np.int64)
    for k, mask in coded.select("class", "home", "reach").mapInArrow(asks, _ASKED).groupBy("list").agg(F.bit_or("mask")).collect():  # a row a list
        masks[k] = mask
    asked = (masks[:, None] >> group[None, :] & 1).astype(bool)  # whether a block of the group probes the list

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            home, near, own = read(batch)
            upto = np.pad(np.cumsum(near, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
            meets = (upto[:, blocks.high] > upto[:, blocks.low]) | asked[home]
            for b in range(len(blocks.low)):
                rows = np.flatnonzero(meets[:, b])
                if len(rows):
                    some = batch.take(pa.array(rows))
                    i, j = np.minimum(own[rows], b), np.maximum(own[rows], b)
                    reach = _packed(np.packbits(near[rows, blocks.low[b] : blocks.high[b]], axis=1))
                    columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[rows] == i), *some.columns[:-1], reach]
                    yield pa.record_batch(columns, [c.split()[0] for c in _DEALT.split(", ")])

    return coded.mapInArrow(deal, _DEALT), blocks


def _search(classes: DataFrame, d: int, limit: float, probes: int | None) -> DataFrame:
    """class, links, root rows of all tiles, for the classes (class, copies, v) of one length."""
    n = classes.count()
    lists = int(min(MOST_LISTS, max(1, n // LIST_VECTORS)))
    share = min(1.0, SAMPLE / n)
    sample = classes.filter(F.pmod(F.xxhash64(F.lit(3), "class"), F.lit(1 << 30)) < int(share * (1 << 30)))
    taken = sample.select("class", "v").toArrow()  # about SAMPLE rows
    unit = _units(taken.column("v").combine_chunks().flatten().to_numpy(), d)[np.argsort(taken.column("class").to_numpy())]
    quantiser = Quantiser.fit(unit, min(lists, len(unit)))
    sent = classes.sparkSession.sparkContext.broadcast(quantiser)
    kind = np.float32 if classes.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    coded = _coded(classes, sent, d, kind, limit, probes)
    most = min(max(BLOCK_VECTORS, -(-n // BLOCKS)), max(1, BLOCK_BYTES // (4 * d)))
    dealt, blocks = _dealt(coded, len(quantiser.centres), most)
    return dealt.groupBy("i", "j").applyInArrow(lambda t: _tile(t, sent.value, blocks, d, kind, limit), _FOUND)


def near_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, probes: int | None = None) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked), component_id (smallest linked id) and kept."""
    plain = _clean(input_columns(rows, vec_id=vec_id, v=vector)).withColumn("sound", F.col("sound") & F.col("vec_id").isNotNull())
    key = F.when(F.col("sound"), F.xxhash64("v"))
    told = stage(plain.select("vec_id", key.alias("class")))
    lone = plain.filter("sound").select(F.xxhash64("v").alias("class"), "vec_id", "v")
    classes = stage(
        lone.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("v").alias("v")).withColumn("d", F.size("v"))
    )
    found = None
    for (d,) in classes.select("d").distinct().sort("d").collect():  # lengths of vectors
        part = _search(classes.filter(F.col("d") == d), d, limit, probes)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return told.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = stage(found)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.filter("class != root").select("class", "root").distinct())
    ids = classes.select("class", "copies", "first_id").join(links, "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    ids = ids.withColumn("root", F.coalesce("root", "class"))
    smallest = ids.groupBy("root").agg(F.min("first_id").alias("component_id"))
    ids = ids.join(smallest, "root").select("class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    whole = told.join(ids, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return whole.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )

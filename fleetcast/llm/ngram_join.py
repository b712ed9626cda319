"""Exact Jaccard join of word n-gram sets, by universe partition and pigeonhole.

*Sets.* A document's set holds its distinct runs of ``k`` words (the whole sequence if it has fewer),
as 64-bit codes. Equal sets are one class and are compared once.

*Partition.* Two sets that reach the similarity differ in few elements: with sizes s and l in at most
H = (s + l)(1 - t)/(1 + t). Sizes are cut into bands. In a band, hashing splits the universe of
elements into m segments, so each set falls into m parts. A set is indexed in its own band and probes
its own and the smaller bands that its partners may be in.

*Pigeonhole with allocation.* A probing set spends H + 1 units: a segment spent 0 is skipped, one
spent 1 must be equal, one spent 2 may differ by one element (its one-deletion neighbourhood meets
the partner's segment or neighbourhood). If all spent segments fail, the sets differ in more than H
elements. There are more segments than units, so a set can leave its costly segments out: first those
with fewest elements, then, when the index has counted them, those in the largest buckets. Small
bands have few segments and use neighbourhoods; large bands have none to spare in rows and do not.

*Verification.* Pairs of small buckets are compared set by set. Large buckets that a set could not leave
out are compared in tiles of keepers against members, which count intersections for all pairs at
once and return only a spanning forest of the links. No result depends on a bucket's size.

Null and empty texts have an empty set and link with nothing. Rows with a null id are returned with a
null component and link with nothing. Rows of one id are one document: their texts are linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.components import components, forest
from fleetcast.llm.frames import input_columns, measured_join
from fleetcast.llm.words import NOT_BLANK, give_back, mix, slices, span_codes, text_bytes, tidied, windows, word_spans
from fleetcast.session import stage

WORDS = 5
#: similarity as a fraction, so that the comparison is exact in integers
SIMILARITY = (4, 5)
#: a band reaches to this many times its smallest size
BAND_RATIO = 1.5
#: segments more than units, as a share
SPARE = 0.2
#: largest size whose band uses one-deletion neighbourhoods
NEAR_SIZE = 40

#: a bucket of more members is large
SMALL_BUCKET = 8
#: index rows of one bucket group, and of one flush of a task
GROUP_ROWS = 1 << 20
FLUSH_ROWS = 1 << 19
#: keepers and members of a tile, and elements multiplied at once
TILE = (512, 1024)
TILE_ELEMENTS = 4096

_PACKED = "part long, entries binary, codes binary, rows binary"
_ENTRY = np.dtype([("id", "<i8"), ("size", "<i4"), ("slack", "<i2"), ("band", "u1"), ("own", "?")])
_MOST_SLACK = (1 << 15) - 1  # less slack than there is only means fewer segments left out
_FOUND = "kind int, a long, b long, code long, n int, slack int, band int, keep boolean, own boolean"
_KEEP, _LARGE = 1 << 15, 1 << 14  # marks of a row beside its entry: spent; in a bucket known to be large


@dataclass(frozen=True)
class Band:
    """Sizes low .. high - 1; ``segments`` parts; ``near``: whether neighbourhoods are indexed."""

    number: int
    low: int
    high: int
    segments: int
    near: bool
    salt: int


def most_different(s, l, t=SIMILARITY):
    """Largest symmetric difference of linked sets of sizes s and l."""
    p, q = t
    return (s + l) * (q - p) // (q + p)


@lru_cache(maxsize=8)
def bands(largest: int, t: tuple[int, int] = SIMILARITY) -> tuple[Band, ...]:
    """All bands up to a size; the same for every document, whatever the corpus."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * BAND_RATIO))
        units = most_different(high - 1, high - 1, t) + 1
        near = high <= NEAR_SIZE
        # with neighbourhoods a segment can be spent twice
        segments = max(1, int(np.ceil(units * (1 + SPARE) / (2 if near else 1))))
        out.append(Band(len(out), low, high, segments, near, int(mix(np.array([len(out) + 1], np.uint64))[0])))
        low = high
    return tuple(out)


def band_of(size: int, all_bands) -> int:
    lo, hi = 0, len(all_bands) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if size < all_bands[mid].high else (mid + 1, hi)
    return lo


def segments(elements: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sum and size of each segment, the segment of each element, and the elements as summed."""
    salted = mix(elements ^ np.uint64(band.salt))
    which = ((salted >> np.uint64(32)) * np.uint64(band.segments) >> np.uint64(32)).astype(np.int64)
    halves = [np.bincount(which, weights=(salted >> np.uint64(k) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=band.segments) for k in (0, 32)]
    total = halves[0].astype(np.uint64) + (halves[1].astype(np.uint64) << np.uint64(32))
    return total, np.bincount(which, minlength=band.segments), which, salted


def signature(total: np.ndarray, segment: np.ndarray, band: Band) -> np.ndarray:
    """Code of a segment's content, its number and its band."""
    return mix(total ^ mix(segment.astype(np.uint64) + np.uint64(band.salt)))


def text_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram codes of each text."""
    raw, at = text_bytes(column)
    start, end, first = word_spans(raw, at, NOT_BLANK)
    code = span_codes(raw, start, end)
    for i in range(len(at) - 1):
        own = code[first[i] : first[i + 1]]
        yield np.unique(windows(own, min(k, len(own)))) if len(own) else np.zeros(0, np.uint64)


def class_of(elements: np.ndarray) -> int:
    """64-bit code of a set."""
    total = mix(elements).sum(dtype=np.uint64) + np.uint64(len(elements))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def allocate(sizes: np.ndarray, units: int, near: bool) -> tuple[np.ndarray, int]:
    """Segments that a set spends, and how many of them it could still leave out.

    The cost of a segment falls with its elements, so those with one or none are left out first; they
    are taken back, larger ones first, if the units don't suffice.
    """
    order = np.argsort(-sizes, kind="stable")
    each = 2 if near else 1
    many = max(int((sizes >= 2).sum()), min(len(sizes), -(-units // each)))
    keep = np.zeros(len(sizes), bool)
    keep[order[:many]] = True
    return keep, 0 if near else many - units


class _Index:
    """Index and probe rows of the sets a task has seen, until they are flushed."""

    def __init__(self, parts: int, t: tuple[int, int]):
        self.parts, self.t = parts, t
        self.clear()

    def clear(self) -> None:
        self.seen: set[int] = set()
        self.entries: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.n = 0

    def full(self) -> bool:
        return self.n >= FLUSH_ROWS or len(self.entries) >= _LARGE - 64

    def add(self, own_id: int, elements: np.ndarray) -> None:
        if own_id in self.seen:
            return
        self.seen.add(own_id)
        size = len(elements)
        known = bands(1 << max(20, size.bit_length() + 1), self.t)
        number = band_of(size, known)
        least = -(-size * self.t[0] // self.t[1])
        self._enter(own_id, elements, known[number], True)
        number -= 1
        while number >= 0 and known[number].high > least:
            self._enter(own_id, elements, known[number], False)
            number -= 1

    def _enter(self, own_id: int, elements: np.ndarray, band: Band, own: bool) -> None:
        size = len(elements)
        total, sizes, which, salted = segments(elements, band)
        units = most_different(size, min(size, band.high - 1), self.t) + 1
        keep, slack = allocate(sizes, units, band.near)
        number = np.arange(band.segments)
        code, spent, part = [signature(total, number, band)], [keep], number
        if band.near:  # each set less one element of the segment
            code.append(signature(total[which] - salted, which, band))
            spent.append(keep[which])
        code, spent = np.concatenate(code), np.concatenate(spent)
        if not own:
            code, spent = code[spent], spent[spent]
        self.codes.append(code)
        self.rows.append((len(self.entries) + spent * _KEEP).astype(np.uint16))
        self.entries.append((own_id, size, min(slack, _MOST_SLACK), band.number, own))
        self.n += len(code)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Rows packed by part. Of a code with more than ``SMALL_BUCKET`` rows here, one goes to the code's
        part; the others, which are sure to be in a large bucket, spread over the parts beyond."""
        if self.n:
            code, row = np.concatenate(self.codes), np.concatenate(self.rows)
            entries = np.array(self.entries, _ENTRY)
            order = np.argsort(code, kind="stable")
            code, row = code[order], row[order]
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            many = np.diff(np.append(begin, len(code)))
            aside = np.repeat(many > SMALL_BUCKET, many)
            row[begin] |= np.where(many > SMALL_BUCKET, np.uint16(_LARGE), np.uint16(0))
            aside[begin] = False
            stands = np.flatnonzero(~aside)
            yield from self._packed(entries, code[stands], row[stands], (code[stands] % np.uint64(self.parts)).astype(np.int64))
            if aside.any():
                spread = self.parts + np.arange(aside.sum()) // GROUP_ROWS + int(code[0] % np.uint64(self.parts))
                yield from self._packed(entries, code[aside], row[aside], spread)
        self.clear()

    def _packed(self, entries, code, row, part) -> Iterator[pa.RecordBatch]:
        order = np.argsort(part, kind="stable")
        part, code, row = part[order], code[order], row[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        out: dict[str, list] = {"part": [], "entries": [], "codes": [], "rows": []}
        for a, b in zip(cut, [*cut[1:], len(part)], strict=True):
            used, which = np.unique(row[a:b] & np.uint16(_LARGE - 1), return_inverse=True)
            out["part"].append(int(part[a]))
            out["entries"].append(entries[used].tobytes())
            out["codes"].append(code[a:b].tobytes())
            out["rows"].append((which.astype(np.uint16) | (row[a:b] & np.uint16(_KEEP | _LARGE))).tobytes())
        kinds = {"part": pa.int64(), "entries": pa.binary(), "codes": pa.binary(), "rows": pa.binary()}
        yield pa.record_batch({c: pa.array(v, kinds[c]) for c, v in out.items()})


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, entries by row, whether the row is spent, and whether it stands for a large bucket."""
    code, entry, keep, large = [], [], [], []
    for e, c, r in zip(*(table.column(x).to_pylist() for x in ("entries", "codes", "rows")), strict=True):
        row = np.frombuffer(r, np.uint16)
        code.append(np.frombuffer(c, np.uint64))
        entry.append(np.frombuffer(e, _ENTRY)[row & np.uint16(_LARGE - 1)])
        keep.append(row & np.uint16(_KEEP) > 0)
        large.append(row & np.uint16(_LARGE) > 0)
    return np.concatenate(code), np.concatenate(entry), np.concatenate(keep), np.concatenate(large)


def _found(kind: int, **columns) -> pa.Table:
    n = len(columns["a"])
    types = {"kind": np.int32, "a": np.int64, "b": np.int64, "code": np.int64, "n": np.int32, "slack": np.int32, "band": np.int32, "keep": bool, "own": bool}
    columns["kind"] = np.full(n, kind)
    return pa.table({c: pa.array(np.asarray(columns.get(c, np.zeros(n))).astype(t)) for c, t in types.items()})


def _buckets(table: pa.Table, parts: int, t: tuple[int, int]) -> pa.Table:
    """Candidate pairs of small buckets (kind 0: smaller set a, larger set b, their shared segments) and
    the rows of large ones (kind 1: member a, smallest member b; kind 2: members set aside before)."""
    code, entry, keep, stands = _unpack(table)
    if table.column("part")[0].as_py() >= parts:
        return _found(2, a=entry["id"], code=code.view(np.int64), slack=entry["slack"], band=entry["band"], keep=keep, own=entry["own"])
    order = np.lexsort((~stands, entry["id"], code))
    code, entry, keep, stands = code[order], entry[order], keep[order], stands[order]
    new = np.concatenate([[True], (code[1:] != code[:-1]) | (entry["id"][1:] != entry["id"][:-1])])  # copies met in other flushes
    code, entry, keep, stands = code[new], entry[new], keep[new], stands[new]
    begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    many = np.diff(np.append(begin, len(code)))
    large = (many > SMALL_BUCKET) | np.logical_or.reduceat(stands, begin)
    row_large = np.repeat(large, many)
    out = []
    if row_large.any():
        hub = np.repeat(entry["id"][begin], many)[row_large]
        e = entry[row_large]
        count = np.repeat(many, many)[row_large]
        out.append(_found(1, a=e["id"], b=hub, code=code[row_large].view(np.int64), n=count, slack=e["slack"], band=e["band"], keep=keep[row_large], own=e["own"]))
    small, larger, slack = [], [], []
    for step in range(1, SMALL_BUCKET):  # rows a step apart in the same small bucket
        x = np.flatnonzero((code[step:] == code[:-step]) & ~row_large[step:])
        y = x + step
        swap = (entry["size"][x] > entry["size"][y]) | ((entry["size"][x] == entry["size"][y]) & (entry["id"][x] > entry["id"][y]))
        s, r = np.where(swap, y, x), np.where(swap, x, y)
        good = keep[r] & entry["own"][s] & (entry["id"][s] != entry["id"][r])
        good &= entry["size"][s].astype(np.int64) * t[1] >= entry["size"][r].astype(np.int64) * t[0]
        small.append(entry["id"][s[good]])
        larger.append(entry["id"][r[good]])
        slack.append(entry["slack"][r[good]])
    a, b, slack = np.concatenate(small), np.concatenate(larger), np.concatenate(slack)
    if len(a):
        order = np.lexsort((b, a))
        a, b, slack = a[order], b[order], slack[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        out.append(_found(0, a=a[first], b=b[first], n=np.diff(np.append(first, len(a))), slack=slack[first]))
    return pa.concat_tables(out) if out else _found(0, a=np.zeros(0, np.int64))


def text_classes(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_shingles and class (null for an empty set), staged."""

    def classes(texts: pa.Array) -> pa.Array:
        n, key = [], []
        for part in slices(pa.record_batch({"text": texts}), "text"):
            for elements in text_sets(part.column("text"), k):
                n.append(len(elements))
                key.append(class_of(elements) if len(elements) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(key, pa.int64())], ["n", "key"])

    classes.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    told = docs.select("doc_id", F.arrow_udf(classes, "struct<n:bigint,key:bigint>")("text").alias("s"))
    return stage(told.select("doc_id", F.col("s.n").alias("n_shingles"), F.col("s.key").alias("class")))


def candidates(docs: DataFrame, rows: int, k: int = WORDS, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Kinds 0 to 2 of ``_buckets``, staged. ``rows``: about how many index rows there will be."""
    parts = max(1, -(-rows // GROUP_ROWS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Index(parts, t)
        for batch in batches:
            for part in slices(batch, "text"):
                for elements in text_sets(part.column("text"), k):
                    if len(elements):
                        held.add(class_of(elements), elements)
                        if held.full():
                            yield from held.flush()
        yield from held.flush()
        give_back()

    packed = docs.select("text").mapInArrow(index, _PACKED)
    return stage(packed.groupBy("part").applyInArrow(lambda x: tidied(_buckets(x, parts, t)), _FOUND))


def large_buckets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of large buckets that must be compared (hub, id, keeper), and large rows per probing set.

    A set leaves its largest buckets out as far as its slack goes.
    """
    told = found.filter("kind = 1")
    # what flushes have set aside belongs to a bucket that is known to be large
    whole = told.groupBy("code").agg(F.min("b").alias("hub"), F.max("n").alias("n"))
    aside = found.filter("kind = 2").select("code", "a", "slack", "band", "keep", "own")
    rows = told.select("code", "a", "slack", "band", "keep", "own").unionByName(aside).distinct()
    counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(counts, "code").join(whole.select("code", "hub"), "code")
    rank = F.row_number().over(Window.partitionBy("a", "band").orderBy(F.desc("n"), "code"))
    kept = rows.filter("keep").withColumn("rank", rank)
    per_set = kept.groupBy("a", "band").agg(F.count(F.lit(1)).alias("n_large"))
    keepers = kept.filter("rank > slack").select("code", "hub", "a")
    live = keepers.select("code").distinct()
    members = rows.filter("own").join(live, "code", "left_semi").select("hub", "a")
    both = keepers.select("hub", "a", F.lit(True).alias("keeper"), F.lit(False).alias("member")).unionByName(
        members.select("hub", "a", F.lit(False).alias("keeper"), F.lit(True).alias("member"))
    )
    return stage(both.groupBy("hub", "a").agg(F.max("keeper").alias("keeper"), F.max("member").alias("member"))), stage(per_set)


def sets_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int = WORDS) -> DataFrame:
    """(class, elements) of the wanted classes, staged; one document stands for its class."""
    chosen = classes.join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    chosen = stage(chosen.filter("doc_id IS NOT NULL"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                want = part.column("class").to_pylist()
                got = [x.tobytes() if len(x) and class_of(x) == w else None for w, x in zip(want, text_sets(part.column("text"), k), strict=True)]
                yield pa.record_batch({"class": part.column("class"), "elements": pa.array(got, pa.binary())})

    found = measured_join(docs, chosen, "doc_id", "inner").select("class", "text").mapInArrow(cut, "class long, elements binary")
    return stage(found.filter("elements IS NOT NULL").dropDuplicates(["class"]))


def _linked(both: np.ndarray, sizes_a, sizes_b, t: tuple[int, int]) -> np.ndarray:
    return both * t[1] >= (sizes_a + sizes_b - both) * t[0]


def verify_pairs(pairs: DataFrame, sets: DataFrame, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            give_back()
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(bool(_linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), t)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _tile(table: pa.Table, t: tuple[int, int]) -> pa.Table:
    """Forest of the links between the keepers and the members of a tile."""
    role = table.column("keeper").to_numpy().astype(bool)
    ids = table.column("a").to_numpy()
    blobs = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("elements").combine_chunks()]
    sides = [np.flatnonzero(role), np.flatnonzero(~role)]
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(sides[0]) or not len(sides[1]):
        return empty
    flat = [(np.concatenate([blobs[i] for i in s]), np.repeat(np.arange(len(s)), [len(blobs[i]) for i in s])) for s in sides]
    shared = np.intersect1d(flat[0][0], flat[1][0])
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    spots = []
    for value, row in flat:
        at = np.minimum(np.searchsorted(shared, value), max(0, len(shared) - 1))
        hit = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        order = np.argsort(at[hit], kind="stable")
        spots.append((at[hit][order], row[hit][order]))
    for low in range(0, len(shared), TILE_ELEMENTS):
        wide = min(TILE_ELEMENTS, len(shared) - low)
        dense = []
        for (at, row), s in zip(spots, sides, strict=True):
            a, b = np.searchsorted(at, [low, low + wide])
            m = np.zeros((len(s), wide), np.float32)
            m[row[a:b], at[a:b] - low] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    size = [np.array([len(blobs[i]) for i in s], np.int64) for s in sides]
    linked = _linked(both.astype(np.int64), size[0][:, None], size[1][None, :], t)
    linked &= ids[sides[0]][:, None] != ids[sides[1]][None, :]
    node, root = forest(linked, ids[sides[0]], ids[sides[1]])
    return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})


def verify_large(large: DataFrame, sets: DataFrame, t: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Forest links (a, b) inside the large buckets: tiles of keepers against members."""
    sized = large.groupBy("hub").agg(
        F.ceil(F.sum(F.col("keeper").cast("int")) / TILE[0]).cast("int").alias("kb"), F.ceil(F.sum(F.col("member").cast("int")) / TILE[1]).cast("int").alias("mb")
    )
    spread = large.join(sized, "hub").filter("kb > 0 AND mb > 0")
    own = F.pmod(F.xxhash64("a", "hub"), F.lit(1 << 30)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = spread.filter("keeper").select("hub", "a", (own % F.col("kb")).alias("i"), upto("mb").alias("j"), F.lit(True).alias("keeper"))
    tiles = tiles.unionByName(spread.filter("member").select("hub", "a", upto("kb").alias("i"), (own % F.col("mb")).alias("j"), F.lit(False).alias("keeper")))
    filled = tiles.join(sets.withColumnRenamed("class", "a"), "a")
    return filled.groupBy("hub", "i", "j").applyInArrow(lambda x: tidied(_tile(x, t)), "a long, b long")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id (smallest linked doc_id, itself included)."""
    plain = input_columns(docs, doc_id=doc_id, text=text)
    classes = text_classes(plain, k)
    told = classes.filter("doc_id IS NOT NULL")
    elements = told.groupBy("class").agg(F.first("n_shingles").alias("n")).agg(F.sum("n")).first()[0] or 0
    known = plain.filter("doc_id IS NOT NULL")
    found = candidates(known, elements * 6 // 10, k, similarity)
    large, per_set = large_buckets(found)
    pairs = found.filter("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("slack").alias("slack"))
    # segments that are equal but lie in large buckets are missing from the count
    missing = per_set.groupBy("a").agg(F.max("n_large").alias("n_large")).withColumnRenamed("a", "b")
    pairs = pairs.join(missing, "b", "left").filter(F.col("n") > F.col("slack") - F.coalesce("n_large", F.lit(0)))
    pairs = stage(pairs.select("a", "b"))
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(large.select("a")).distinct()
    sets = sets_of(known, told, stage(wanted), k)
    links = verify_pairs(pairs, sets, similarity).unionByName(verify_large(large, sets, similarity))
    # rows of one id are one document
    torn = told.groupBy("doc_id").agg(F.min("class").alias("b"), F.max("class").alias("c")).filter("b != c").drop("c")
    links = links.unionByName(told.join(torn, "doc_id").filter("class != b").select(F.col("class").alias("a"), "b").distinct())
    roots = components(stage(links))
    # a component is known by its smallest document
    first = told.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("d"))
    joined = first.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = joined.groupBy("root").agg(F.min("d").alias("component_id"))
    ids = joined.select("class", "root").join(smallest, "root").select("class", "component_id")
    whole = classes.join(ids, "class", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of linked ones, that with the smallest id.

    Rows of one id are one document: that with the smallest hash of the text stays. Rows without an id stay.
    """
    told = stage(near_duplicates(docs, doc_id=doc_id, text=text, k=k, similarity=similarity))
    gone = stage(told.filter("doc_id != component_id").select(F.col("doc_id").alias(doc_id)).distinct())
    twice = stage(told.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(doc_id)).count().filter("count > 1").select(doc_id))
    kept = measured_join(docs, gone, doc_id, "left_anti")
    if twice.isEmpty():
        return kept
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = measured_join(kept, twice, doc_id, "left_semi").select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), row.alias("_row"))
    one = again.groupBy("_id").agg(F.min_by("_row", "_h").alias("_row")).select("_row.*")
    return measured_join(kept, twice, doc_id, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(one)

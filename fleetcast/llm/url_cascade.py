"""URL filtering: host and path rules, and exact list membership by a Bloom filter cascade.

The list may hold any number of keys. A cascade encodes the listed keys in a Bloom filter, the
unlisted keys of the corpus that pass it in a second one, the listed keys that pass the second in
a third, and so on until none is left over. As it is built over *all* keys of the corpus, a
look-up in it is exact for every row, and rows are never joined with the list.

Null and malformed urls have an empty host and path; that key is never listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.frames import fold_ascii
from fleetcast.llm.words import mix
from fleetcast.session import stage

#: keys in one shard of the cascade, which one task builds
SHARD_KEYS = 1 << 17
#: filters are shipped to every task up to this size, and dealt out with the rows beyond it
SHIPPED_BYTES = 32 << 20
#: rows that look up a dealt-out filter together
DEAL_ROWS = 1 << 16

_FIRST_BITS, _LATER_BITS = 12, 2  # bits a key: few false positives first, a short tail then
_FILTER = "shard long, level int, size long, probes int, bits binary"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return fold_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null without one).

    A rule fits its host and all subdomains where the path starts with the rule's path; of equally
    long rules the first by name wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def codes(*key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit codes of a key."""
    return F.xxhash64(F.lit(17), *key), F.xxhash64(F.lit(71), *key)


def _slots(a: np.ndarray, b: np.ndarray, level: int, size: int, probes: int) -> np.ndarray:
    """Bit positions of each key in a filter of ``size`` bits, one column a probe."""
    first = mix(a ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = mix(b + np.uint64(level)) | np.uint64(1)
    return (first[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(size)


def _passes(a: np.ndarray, b: np.ndarray, level: int, size: int, probes: int, bits: np.ndarray) -> np.ndarray:
    at = _slots(a, b, level, size, probes)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build_levels(listed: tuple, others: tuple) -> list[tuple[int, int, int, np.ndarray]]:
    """Levels (level, size, probes, bits) that separate the listed keys from the others."""
    inside, outside, levels = listed, others, []
    while len(inside[0]):
        level = len(levels) + 1
        if level > 64:
            raise ValueError("a listed and an unlisted key share both 64-bit codes")
        per_key = _FIRST_BITS if level == 1 else _LATER_BITS
        size = max(64, per_key * len(inside[0]) + 7 & ~7)
        probes = max(1, round(per_key * 0.6931))
        bits = np.zeros(size // 8, np.uint8)
        at = _slots(*inside, level, size, probes).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        levels.append((level, size, probes, bits))
        wrong = _passes(*outside, level, size, probes, bits) if len(outside[0]) else np.zeros(0, bool)
        inside, outside = tuple(x[wrong] for x in outside), inside
    return levels


def look_up(a: np.ndarray, b: np.ndarray, levels: Sequence[tuple]) -> np.ndarray:
    """Which keys are listed: the first level that a key fails decides."""
    listed = np.zeros(len(a), bool)
    open_ = np.arange(len(a))
    for level, size, probes, bits in levels:
        passed = _passes(a[open_], b[open_], level, size, probes, bits)
        listed[open_[~passed]] = level % 2 == 0
        open_ = open_[passed]
    listed[open_] = len(levels) % 2 == 1
    return listed


def _uint(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def build_cascade(keys: DataFrame, listed: Column, *key: Column) -> DataFrame:
    """Filters of all shards, staged. ``keys`` holds every key of the corpus; repeated rows don't matter."""
    a, b = codes(*key)
    coded = stage(keys.select(a.alias("a"), b.alias("b"), listed.alias("l")).groupBy("a", "b").agg(F.max("l").alias("l")))
    shards = max(1, -(-coded.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        a, b = (_uint(table.column(c).combine_chunks()) for c in "ab")
        l = table.column("l").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        levels = build_levels((a[l], b[l]), (a[~l], b[~l]))
        shard = table.column("shard")[0].as_py()
        return pa.table(
            {
                "shard": pa.array([shard] * len(levels), pa.int64()),
                "level": pa.array([x[0] for x in levels], pa.int32()),
                "size": pa.array([x[1] for x in levels], pa.int64()),
                "probes": pa.array([x[2] for x in levels], pa.int32()),
                "bits": pa.array([x[3].tobytes() for x in levels], pa.binary()),
            }
        )

    dealt = coded.withColumn("shard", F.pmod("a", F.lit(shards)).cast("long"))
    return stage(dealt.groupBy("shard").applyInArrow(build, _FILTER)), shards


def _levels(table: pa.Table) -> dict[int, list[tuple]]:
    found: dict[int, list[tuple]] = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["shard"], r["level"])):
        found.setdefault(r["shard"], []).append((r["level"], r["size"], r["probes"], np.frombuffer(r["bits"], np.uint8)))
    return found


def _by_shard(a: np.ndarray, b: np.ndarray, shards: int, levels: dict[int, list[tuple]]) -> np.ndarray:
    shard = a.view(np.int64) % shards  # floored, as pmod
    out = np.zeros(len(a), bool)
    for s in np.unique(shard):
        rows = shard == s
        out[rows] = look_up(a[rows], b[rows], levels.get(int(s), []))
    return out


def with_membership(
    rows: DataFrame, cascade: tuple[DataFrame, int], key: Sequence[Column], name: str = "listed", shipped: int = SHIPPED_BYTES
) -> DataFrame:
    """``rows`` with a boolean column: is the key listed. Exact for all keys the cascade was built over.

    Filters up to ``shipped`` bytes go to every task. Larger ones are dealt out by shard, each with
    as many copies as its rows need tasks, so that a hot key spreads over many tasks.
    """
    filters, shards = cascade
    a, b = codes(*key)
    size = filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= shipped:
        sent = rows.sparkSession.sparkContext.broadcast(_levels(filters.toArrow()))

        @F.arrow_udf("boolean")
        def listed(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array(_by_shard(_uint(a), _uint(b), shards, sent.value))

        return rows.withColumn(name, listed(a, b))

    coded = stage(rows.withColumns({"_a": a, "_b": b}).withColumn("_s", F.pmod("_a", F.lit(shards)).cast("long")))
    copies = coded.groupBy("_s").agg(F.ceil(F.count(F.lit(1)) / DEAL_ROWS).alias("_n"))
    spread = coded.join(copies, "_s").withColumn("_c", F.floor(F.rand(7) * F.col("_n"))).drop("_n")
    sides = filters.join(copies.withColumnRenamed("_s", "shard"), "shard").withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    )
    kept = [f for f in rows.schema]

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = _levels(right)
        a, b = (_uint(left.column(c).combine_chunks()) for c in ("_a", "_b"))
        return left.select([f.name for f in kept]).append_column(name, pa.array(_by_shard(a, b, shards, levels)))

    schema = rows.withColumn(name, F.lit(True)).schema
    return spread.groupBy("_s", "_c").cogroup(sides.withColumnRenamed("shard", "_s").groupBy("_s", "_c")).applyInArrow(evaluate, schema)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    url: str = "url",
    trap_variants: int = 3,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict ("allow" or "block").

    The verdict is the longest fitting rule's. Where none fits, a page is blocked if its host and
    path are listed as a crawler trap: a key that the corpus has under ``trap_variants`` or more
    different urls (session ids, tracking parameters). The list grows with the corpus and is looked
    up in a cascade. Urls without host and path (null, no scheme) are no trap, however many there are. Columns of ``pages`` named like a result are replaced.
    """
    base = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # distinct urls first: the copies of a hot url meet on the map side
    urls = base.select("host", "path", F.col(url).alias("_u")).distinct()
    keys = urls.groupBy("host", "path").agg((F.count("_u") >= trap_variants).alias("trap"))
    keys = keys.withColumn("trap", F.col("trap") & ((F.col("host") != "") | (F.col("path") != "")))
    cascade = build_cascade(keys, F.col("trap"), F.col("host"), F.col("path"))
    found = with_membership(base, cascade, [F.col("host"), F.col("path")], "_trap")
    rule, verdict = match_rule(rules, F.col("host"), F.col("path"))
    default = F.when(F.col("_trap"), "block").otherwise("allow")
    return found.withColumns({"rule": rule, "verdict": F.coalesce(verdict, default)}).drop("_trap")

"""Global and per-key order without a single-task window.

Everything that needs an order (running totals, as-of lookups, dense ids, ranks,
quantiles) is computed on *order chunks*: the input is range-partitioned on the sort key,
so that one hot key spreads over many chunks, and staged once so that the chunk limits
cannot move. Work inside a chunk is an ordinary window; what a key needs to know from its
earlier (or later) chunks is a small carry table with fewer rows than there are chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetcast.session import stage

CHUNK = "_chunk"
POS = "_pos"
IDX = "_idx"
HALO = "_halo"

# optional fixed chunk count; tests use it to force keys across chunk limits
CHUNKS_CONF = "spark.fleetcast.orderChunks"

_POS_MASK = (1 << 33) - 1

#: bytes of a chunk at most, and how much wider rows are in memory than in their files
CHUNK_BYTES = 256 << 20
EXPANSION = 3
_UNKNOWN = 1 << 60

# rank error of the quantile sketch is 1 / accuracy; brackets are several errors wide
_SKETCH_ACCURACY = 10_000
_BRACKET = 4


def input_bytes(df: DataFrame) -> int:
    """Bytes that the sources of ``df`` hold, as far as the planner knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < _UNKNOWN)


def _chunk_count(df: DataFrame) -> int | None:
    """Chunks for an input that the session's shuffle partitions would make too large; None: AQE sizes them."""
    wanted = -(-input_bytes(df) * EXPANSION // CHUNK_BYTES)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def order_chunks(df: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range-partition ``df`` on ``by`` and stage it with a chunk number and a position.

    Rows equal in ``by`` share a chunk; chunk numbers follow the order of ``by``.
    """
    # without a fixed number, AQE sizes the chunks from the shuffle statistics
    fixed = parts or df.sparkSession.conf.get(CHUNKS_CONF, None) or _chunk_count(df)
    spread = (int(fixed), *by) if fixed else tuple(by)
    ranged = df.repartitionByRange(*spread).sortWithinPartitions(*by)
    # monotonically_increasing_id() = partition number and row position in sorted order
    mid = F.monotonically_increasing_id()
    tagged = ranged.withColumn("_mid", mid)
    return stage(
        tagged.select(
            "*",
            F.shiftright("_mid", 33).cast("int").alias(CHUNK),
            F.col("_mid").bitwiseAND(F.lit(_POS_MASK)).alias(POS),
        ).drop("_mid")
    )


def with_index(chunked: DataFrame) -> DataFrame:
    """Add ``_idx``, the dense 0-based position of a row in the global order."""
    sizes = chunked.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per chunk
    return (
        chunked.join(F.broadcast(offsets), CHUNK)
        .withColumn(IDX, F.col("_offset") + F.col(POS))
        .drop("_offset")
    )


def crossing_rows(chunked: DataFrame, key: str) -> DataFrame:
    """Rows of the values of ``key`` (the first column of the order) that lie in more than one chunk.

    Such values are fewer than there are chunks; a count of two whole numbers per value finds them.
    """
    spread = chunked.groupBy(F.col(key).alias("_crossing")).agg(F.min(CHUNK).alias("_from"), F.max(CHUNK).alias("_upto"))
    crossing = spread.filter("_from < _upto").select("_crossing")
    return chunked.join(F.broadcast(crossing), F.col(key).eqNullSafe(F.col("_crossing")), "left_semi")


def carry_over(
    chunked: DataFrame,
    keys: Sequence[str],
    partials: dict[str, Column],
    merge: dict[str, Callable[[str], Column]],
    *,
    backward: bool = False,
    lead: str | None = None,
) -> DataFrame:
    """What each key brings into a chunk from the chunks before it (after it if ``backward``).

    Only keys that continue across a chunk limit get a row, so the result has fewer rows
    than there are chunks and is always safe to broadcast. With ``lead``, the key that the order begins with,
    only rows of its values that lie in several chunks are aggregated.
    """
    if lead is not None:
        chunked = crossing_rows(chunked, lead)
    per = chunked.groupBy(*keys, CHUNK).agg(*[e.alias(n) for n, e in partials.items()])
    order = F.col(CHUNK).desc() if backward else F.col(CHUNK).asc()
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    merged = per.select(
        *keys,
        CHUNK,
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
        *[fn(n).over(earlier).alias(n) for n, fn in merge.items()],
    )
    return merged.filter("_earlier > 0").drop("_earlier")


def join_carry(chunked: DataFrame, keys: Sequence[str], carry: DataFrame) -> DataFrame:
    """Attach a carry table (bounded by the number of chunks) to its chunk rows."""
    renamed = carry.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(CHUNK).alias("_k_chunk"),
        *[c for c in carry.columns if c not in keys and c != CHUNK],
    )
    match = F.col(CHUNK) == F.col("_k_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return chunked.join(F.broadcast(renamed), match, "left").drop(
        "_k_chunk", *[f"_k_{k}" for k in keys]
    )


def chunk_window(keys: Sequence[str], *order: str | Column) -> WindowSpec:
    """Window over the rows of a key inside one chunk."""
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def with_halo(chunked: DataFrame, keys: Sequence[str], order: str, width: int) -> DataFrame:
    """Put the rows of a key into lanes, each with the rows less than ``width`` before its start.

    A lane is the chunks of a key that begin in the same stretch of ``width``; it takes the number
    of its first chunk. Trailing windows no longer than ``width`` are complete inside
    ``(keys, chunk)`` then. A row is copied into the two lanes after its own at most, however many
    chunks there are; copies are marked in ``_halo``. The table of lanes holds only keys that
    cross a chunk limit, hence fewer rows than there are chunks.
    """
    near_limits = crossing_rows(chunked, keys[0]) if keys else chunked
    spans = near_limits.groupBy(*keys, CHUNK).agg(F.min(order).alias("_first"))
    of_key = Window.partitionBy(*(keys or [F.lit(0)]))
    stretch = Window.partitionBy(*keys, F.floor(F.col("_first") / F.lit(width)))
    spans = spans.withColumns(
        {
            "_chunks": F.count(F.lit(1)).over(of_key),
            "_lane": F.min(CHUNK).over(stretch),
            "_start": F.min("_first").over(stretch),
        }
    ).filter("_chunks > 1")
    by_start = of_key.orderBy("_start")
    lanes = spans.select(*keys, "_lane", "_start").distinct()
    later = [F.struct(F.lead("_lane", k).over(by_start).alias("chunk"), F.lead("_start", k).over(by_start).alias("first")) for k in (1, 2)]
    lanes = lanes.withColumn("_near", F.filter(F.array(*later), lambda b: b["chunk"].isNotNull())).drop("_start")
    targets = spans.select(*keys, CHUNK, "_lane")
    for k in keys:
        lanes = lanes.withColumnRenamed(k, f"_l_{k}")
    same = F.col("_lane") == F.col("_l_lane")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_l_{k}"))
    targets = targets.join(lanes.withColumnRenamed("_lane", "_l_lane"), same).select(*keys, CHUNK, "_lane", "_near")
    reach = F.filter(
        F.coalesce("_near", F.array().cast("array<struct<chunk:int,first:bigint>>")),
        lambda b: F.col(order) > b["first"] - F.lit(width),
    )
    home = F.array(F.struct(F.coalesce("_lane", CHUNK).alias("chunk"), F.lit(False).alias("halo")))
    copies = F.transform(
        reach, lambda b: F.struct(b["chunk"].alias("chunk"), F.lit(True).alias("halo"))
    )
    placed = join_carry(chunked, keys, targets).withColumn(
        "_place", F.explode(F.concat(home, copies))
    )
    return placed.select(
        *[c for c in chunked.columns if c != CHUNK],
        F.col("_place.chunk").alias(CHUNK),
        F.col("_place.halo").alias(HALO),
    )


def ranked_histogram(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: dict[str, Column] | None = None,
    *,
    count: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row per (keys, value) with counts, counts before it in the order, and key totals.

    ``weights`` are extra summed measures. For each measure ``m`` (``n`` is the row count)
    the result has ``m``, ``m_before`` and ``m_total``. Duplicates are merged before any
    ordering, so a value held by a third of the rows costs one row. ``count`` gives the
    row count of input that is already merged.
    """
    if not keys:
        raise ValueError("name at least one key (a constant column for a single group)")
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    measures = {"n": n, **{m: F.sum(e) for m, e in (weights or {}).items()}}
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[e.alias(m) for m, e in measures.items()])
    )
    chunked = order_chunks(hist, [*keys, value], parts)
    names = list(measures)
    carry = carry_over(
        chunked,
        keys,
        {f"_c_{m}": F.sum(m) for m in names},
        {f"_c_{m}": F.sum for m in names},
    )
    totals = chunked.groupBy(*keys).agg(*[F.sum(m).alias(f"{m}_total") for m in names])
    before = chunk_window(keys, value).rowsBetween(Window.unboundedPreceding, -1)
    out = join_carry(chunked, keys, carry).select(
        *keys,
        value,
        *names,
        *[
            (
                F.coalesce(F.col(f"_c_{m}"), F.lit(0)) + F.coalesce(F.sum(m).over(before), F.lit(0))
            ).alias(f"{m}_before")
            for m in names
        ],
    )
    return out.join(totals, list(keys))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: columns named by ``probs``, plus ``n``.

    A sketch brackets every quantile; one more pass keeps the distinct values inside the
    brackets (a tiny share of the data) and merges all others into one row per side, and
    only those few rows are ordered. Should a bracket miss its rank, the full order of
    values is used instead.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    edges = [
        min(1.0, max(0.0, p + side * _BRACKET / _SKETCH_ACCURACY))
        for p in probs.values()
        for side in (-1, 1)
    ]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", edges, _SKETCH_ACCURACY).alias("_e")
    )
    v, e = F.col("_v"), F.col("_e")
    brackets = [(e[2 * i], e[2 * i + 1]) for i in range(len(probs))]
    inside = reduce(lambda a, b: a | b, [v.between(lo, hi) for lo, hi in brackets])
    # rows outside every bracket differ only in how many brackets lie below them
    region = reduce(lambda a, b: a + b, [(v > hi).cast("int") for _, hi in brackets])
    merged = (
        rows.join(sketch.select(*keys, "_e"), list(keys))
        .groupBy(*keys, F.when(inside, v).alias("_in"), F.when(~inside, region).alias("_region"))
        .agg(F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_v"), F.max("_v").alias("_last"))
    )
    ranked = ranked_histogram(
        merged, keys, "_v", {"_last": F.col("_last")}, count=F.col("_m")
    )
    got = _interpolated(ranked, keys, probs)
    if got.filter("_missed").isEmpty():
        return got.drop("_missed")
    full = ranked_histogram(rows, keys, "_v").withColumn("_last", F.col("_v"))
    return _interpolated(full, keys, probs).drop("_missed")


def _interpolated(ranked: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from runs of values (first ``_v``, ``_last``, count and counts before).

    A run of different values is known at its two ends only; ``_missed`` marks keys with a
    rank strictly inside such a run.
    """
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    single = F.col("_v") == F.col("_last")
    aggs = [F.max("n_total").alias("n")]
    for i, p in enumerate(probs.values()):
        pos = F.lit(p) * (F.col("n_total") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(pos - lo).alias(f"_f{i}"))
        for tag, rank in (("lo", lo), ("hi", hi)):
            at = (
                F.when((rank == first) | (single & rank.between(first, last)), F.col("_v"))
                .when(rank == last, F.col("_last"))
            )
            aggs.append(F.max(at).alias(f"_{tag}{i}"))
    got = ranked.groupBy(*keys).agg(*aggs)
    out, missed = [], F.lit(False)
    for i, name in enumerate(probs):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + F.col(f"_f{i}") * (hi - lo)).alias(name))
        missed = missed | lo.isNull() | hi.isNull()
    return got.select(*keys, "n", *out, missed.alias("_missed"))


def average_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: dict[str, Column] | None = None,
    count: Column | None = None,
) -> DataFrame:
    """Histogram with ``avg_rank``, the mean 1-based rank that tied values share."""
    ranked = ranked_histogram(df, keys, value, weights, count=count)
    return ranked.withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / 2)


def number_order(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with its dense position in the order of ``by``."""
    return with_index(order_chunks(df, by)).drop(CHUNK, POS)

"""Shards of nearly equal bytes, groups kept together: longest processing time first.

Rows of equal text are a group. Groups come in the order of their size, largest first, and each goes to
the shard with the least bytes so far (ties: the smaller shard number), which a heap gives.

The order of the heap depends on sizes only, so it runs over a bounded histogram. Groups of at least
``total / (shards * GRAIN)`` bytes are at most ``shards * GRAIN``, whatever the corpus, and keep their exact size;
smaller ones are put into classes by the leading ``DIGITS`` bits of their size. Inside a class the
heap deals in turn, so the shards' loads differ from exact sizes by less than one grain over all classes together
(the classes' widths add up to it). Spark numbers the groups of a class by a range partitioning
of (class, size, digest) and looks each one's shard up in the class's plan.

Copies are merged map-side before they move; a text held by more than one row in ``HEAVY`` joins by
broadcast (fewer than ``HEAVY`` such texts), all others by a shuffle on their digest. Only ids, sizes
and digests move, never texts.

A null text is empty, so null and empty texts are one group; ids may be null or repeat; rows that are equal
throughout differ in their slot only. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcast.llm.frames import input_columns, measured_join
from fleetcast.operators.ordered import CHUNK, IDX, POS, order_chunks, with_index
from fleetcast.session import stage

#: bytes that a row weighs besides its text
ROW_BYTES = 16
GRAIN = 4096
DIGITS = 12
#: a text with more than rows / HEAVY copies is heavy
HEAVY = 4096


def deal(heap: list[tuple[int, int]], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Shards of ``count`` groups of one size, as (first rank, shards in turn): ranks go round the list.

    ``heap`` holds (bytes, shard) and is updated. Few groups are dealt one by one. Otherwise the shards less than
    one size above the least take turns, and go on in this order until a fuller shard is the least in between.
    """
    if count <= len(heap):
        order = []
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            order.append(shard)
        return [(0, order)]
    plan, done = [], 0
    while done < count:
        turn, lowest = [], heap[0][0]
        while heap and heap[0][0] < lowest + size:
            turn.append(heapq.heappop(heap))
        take = count - done
        if heap:
            gap, fuller = heap[0][0] - turn[-1][0], turn[-1][1] < heap[0][1]
            take = min(take, len(turn) * (-(-gap // size) + (gap % size == 0 and fuller)))
        plan.append((done, [shard for _, shard in turn]))
        full, rest = divmod(take, len(turn))
        for k, (load, shard) in enumerate(turn):
            heapq.heappush(heap, (load + size * (full + (k < rest)), shard))
        done += take
    return plan


def size_class(size: str, grain: int) -> Column:
    """Sizes from ``grain`` on as they are, smaller ones by their leading bits."""
    small = F.expr(f"greatest(length(bin({size})) - {DIGITS}, 0)")
    return F.when(F.col(size) >= grain, F.col(size)).otherwise(F.call_function("shiftleft", F.call_function("shiftright", F.col(size), small), small))


def plan_rows(histogram: Iterable[tuple[int, int, int]], shards: int) -> list[tuple[int, int, list[tuple[int, list[int]]]]]:
    """(class, groups before it, its plan) from (class, groups, bytes), largest class first."""
    heap = [(0, s) for s in range(shards)]
    out, before = [], 0
    for cls, count, total in sorted(histogram, reverse=True):
        out.append((cls, before, deal(heap, total // count, count)))
        before += count
    return out


def shard_groups(docs: DataFrame, shards: int, *, doc_id: str = "doc_id", text: str = "text", grain: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    ``slot`` numbers the rows of a shard by id, then digest, without gaps.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(words, 256)), 1, 16)
    base = stage(
        input_columns(docs, doc_id=doc_id, text=text).select(
            "doc_id", (F.octet_length(words).cast("long") + ROW_BYTES).alias("size"), F.crc32(words).alias("text_crc32"), digest.alias("digest")
        )
    )
    groups = base.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
    groups = stage(groups.select("digest", "copies", (F.col("copies") * F.col("size")).alias("bytes")))
    rows, total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    grain = grain or max(1, total // (shards * GRAIN))
    classed = groups.withColumn("cls", size_class("bytes", grain))
    # at most shards * GRAIN large sizes and 2**DIGITS classes for each doubling below
    histogram = classed.groupBy("cls").agg(F.count(F.lit(1)), F.sum("bytes")).collect()
    kind = "cls long, before long, plan array<struct<first:bigint,turn:array<int>>>"
    plan = stage(spark.createDataFrame(plan_rows([tuple(r) for r in histogram], shards), kind))
    ranked = with_index(order_chunks(classed.withColumn("falling", -F.col("bytes")), ["falling", "digest"])).drop(CHUNK, POS)
    rank = F.col(IDX) - F.col("before")
    step = F.element_at(F.filter("plan", lambda p: p["first"] <= rank), -1)
    placed = measured_join(ranked, plan, "cls", "inner", row_width=64 + 8 * shards).withColumn("_step", step)
    turn = F.col("_step.turn")
    dealt = stage(
        placed.select("digest", "copies", F.get(turn, ((rank - F.col("_step.first")) % F.size(turn)).cast("int")).alias("shard"))
    )
    heavy = F.col("copies") * HEAVY > rows  # fewer than HEAVY texts
    hot = F.broadcast(dealt.filter(heavy).select("digest", "shard"))
    often = base.join(hot, "digest")
    seldom = base.join(F.broadcast(dealt.filter(heavy).select("digest")), "digest", "left_anti")
    all_rows = often.unionByName(seldom.join(dealt.filter(~heavy).select("digest", "shard"), "digest"))
    numbered = with_index(order_chunks(all_rows, ["shard", "doc_id", "digest"]))
    first = numbered.groupBy("shard").agg(F.min(IDX).alias("first"))  # one row a shard
    return numbered.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col(IDX) - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

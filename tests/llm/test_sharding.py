"""Shards by longest processing time against a plain heap."""

from __future__ import annotations

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetcast.llm import queries, sharding


def plain_shards(sizes, shards):
    """Shard of each size; sizes come largest first."""
    heap, out = [(0, s) for s in range(shards)], []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def unrolled(plan, count):
    out = []
    for k, (first, turn) in enumerate(plan):
        end = plan[k + 1][0] if k + 1 < len(plan) else count
        out += [turn[r % len(turn)] for r in range(end - first)]
    return out


def test_classes_are_dealt_as_one_by_one():
    rnd = random.Random(2)
    for _ in range(300):
        shards = rnd.randrange(1, 8)
        left, classes = rnd.randrange(50, 200), []
        for _ in range(rnd.randrange(1, 8)):
            left = max(1, left - rnd.choice([0, 1, 3, 40]))
            if not classes or left < classes[-1][0]:
                classes.append((left, rnd.choice([1, 2, 5, 17, 90])))
        sizes = [s for s, n in classes for _ in range(n)]
        got = []
        for (_, before, plan), (_, n) in zip(sharding.plan_rows([(s, n, s * n) for s, n in classes], shards), classes, strict=True):
            assert before == len(got)
            got += unrolled(plan, n)
        assert got == plain_shards(sizes, shards)


def test_plans_stay_small():
    """A billion groups of a class are a plan of a few rows."""
    rows = sharding.plan_rows([(10**12, 1, 10**12), (999, 10**9, 999 * 10**9), (17, 10**9, 17 * 10**9)], 40)
    assert sum(len(p) for _, _, p in rows) < 90


def checked(df, rows, shards, **more):
    """Rows of the operator after the checks that hold for any input: all rows, sizes, slots, groups together."""
    got = sharding.shard_groups(df, shards, **more).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in got) == sorted(
        (i is not None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert {(r.law, r.grown_shard) for r in got} <= {("bytes", None)}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return got


def group_loads(rows):
    return sorted(((len(t.encode()) + 16) * n for t, n in Counter(t or "" for _, t in rows).items()), reverse=True)


def by_shard(got, shards):
    load = [0] * shards
    for r in got:
        load[r.shard] += r.size
    return load


ODD = [(1, None), (1, None), (None, ""), (2, "x"), (2, "x"), (3, "été"), (None, "long " * 5000), (7, "x"), (8, "y"), (9, "zz")]


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(spark, chunks, shards):
    df = spark.createDataFrame([(*r, 1, "a", b"d") for r in ODD], "doc_id long, text string, size int, shard string, digest binary")
    got = checked(df, ODD, shards)
    loads = group_loads(ODD)
    want = [0] * shards
    for size, s in zip(loads, plain_shards(loads, shards), strict=True):
        want[s] += size
    assert by_shard(got, shards) == want
    assert sharding.shard_groups(df.limit(0), shards).count() == 0


def test_hot_group_and_corpus(spark):
    """The heap's loads exactly, with a third of the rows in one group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10**6 + i, "hot text") for i in range(len(rows) // 2)]
    got = checked(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, 12)
    loads = group_loads(rows)
    want = [0] * 12
    for size, s in zip(loads, plain_shards(loads, 12), strict=True):
        want[s] += size
    assert by_shard(got, 12) == want


def test_coarse_classes_stay_near_equal(spark):
    """Sizes below the grain are rounded; loads differ by little more than a grain."""
    rnd = random.Random(8)
    rows = [(i, f"{i} " + "w" * rnd.randrange(1, 20_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    load = by_shard(checked(df, rows, 6, grain=30_000), 6)
    assert max(load) - min(load) <= 200
    classes = df.select(F.octet_length("text").cast("long").alias("b")).select(sharding.size_class("b", 15_000).alias("c"), "b").collect()
    assert all(r.c == (r.b if r.b >= 15_000 or r.b < 4096 else r.b >> (r.b.bit_length() - 12) << (r.b.bit_length() - 12)) for r in classes)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    load = defaultdict(int)
    got = queries.op11_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(rows)
    for r in got:
        load[r.shard] += r.size
    assert sorted(load) == list(range(40)) and max(load.values()) - min(load.values()) < 100

"""Connected components of links held in a table, without moving them to one place.

Tasks first replace their own links by a spanning forest. Then every round points all larger
neighbours of a node at its smallest neighbour, and each node at its smallest smaller one, until
nothing changes. Rounds are written to the shared folder. A node with very many links is only ever
grouped by partial minima and joined in a join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.session import stage


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes that a boolean matrix of links joins to a smaller one.

    ``rows`` and ``columns`` are node numbers and may share nodes; a root is the smallest of its component.
    """
    i, j = linked.any(axis=1), linked.any(axis=0)
    linked, rows, columns = linked[np.ix_(i, j)], rows[i], columns[j]
    nodes, at = np.unique(np.concatenate([rows, columns]), return_inverse=True)
    r, c = at[: len(rows)], at[len(rows) :]
    label = np.arange(len(nodes))
    big = len(nodes)
    while True:
        new = label.copy()
        np.minimum.at(new, r, np.where(linked, new[c][None, :], big).min(axis=1, initial=big))
        np.minimum.at(new, c, np.where(linked, new[r][:, None], big).min(axis=0, initial=big))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.record_batch({"a": pa.array(part, pa.int64()), "b": pa.array([find(x) for x in part], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns); root is the smallest node it can reach."""
    a, b = links.columns
    plain = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b")
    edges = stage(plain.mapInArrow(_contract, "a long, b long").filter("a > b").distinct())
    size = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    while size[0]:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ends.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
        new = stage(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
        told = new.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        edges, done, size = new, told == size, told
        if done:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

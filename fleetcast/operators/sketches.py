"""Profiles that add up over deliveries: stored distinct-count sketches, joined by union instead of a rescan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.operators.reshape import long_rows
from fleetcast.sources.sinks import overwrite

#: registers of a sketch are 2**PRECISION; its relative standard error is 1.04 / sqrt(registers)
PRECISION = 14
STANDARD_ERROR = 1.04 / 2 ** (PRECISION / 2)
#: the stated bound is this many standard errors
BOUND = 4


def profile_states(df: DataFrame, delivery: str) -> DataFrame:
    """(delivery, column, type, n_rows, n_null, sketch) of every column, from one aggregate over the rows."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(df.columns):
        v = F.col(f"`{c}`")
        aggs += [F.count(F.when(v.isNull(), 1)).alias(f"null_{i}"), F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(PRECISION)).alias(f"sketch_{i}")]
    rows = {
        c: {"type": F.lit(kind), "n_rows": F.col("n_rows"), "n_null": F.col(f"null_{i}"), "sketch": F.col(f"sketch_{i}")} for i, (c, kind) in enumerate(df.dtypes)
    }
    return long_rows(df.agg(*aggs), rows, "column").select(F.lit(delivery).alias("delivery"), "column", "type", "n_rows", "n_null", "sketch")


def save_states(states: DataFrame, path: str) -> None:
    """Store the states of a delivery; storing it again replaces it."""
    overwrite(states, path, ["delivery"])


def merged_profile(states: DataFrame, deliveries: Sequence[str] | None = None) -> DataFrame:
    """Profile of all (or the named) deliveries from their stored states.

    ``n_unique`` is an estimate and ``n_unique_bound`` how far it may be off; ``profile`` counts exactly.
    """
    chosen = states if deliveries is None else states.filter(F.col("delivery").isin(list(deliveries)))
    merged = chosen.groupBy("column").agg(
        F.max("type").alias("type"),
        (F.min("type") == F.max("type")).alias("same_type"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"),
    )
    return merged.withColumn("n_unique_bound", F.ceil(F.col("n_unique") * BOUND * STANDARD_ERROR))

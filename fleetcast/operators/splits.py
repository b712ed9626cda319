"""Chronological splits, time-ordered folds and how comparable their parts are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.operators.ordered import IDX, number_order
from fleetcast.operators.reshape import long_rows
from fleetcast.roles import HORIZONS_H, SMD_NOTABLE, SPLIT_RATIOS, SPLITS


def split_cuts(df: DataFrame, us: str, ratios: Sequence[float] = SPLIT_RATIOS) -> tuple[float, ...]:
    """Instants that cut the time *span* (not the rows) at the given shares: two scalars."""
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    if lo is None:
        return (0.0, 0.0)
    return tuple(lo + (hi - lo) * r for r in ratios)


def split_column(us: str, cuts: Sequence[float]) -> Column:
    """train before the first cut, val before the second, test after."""
    first, second = cuts
    return (
        F.when(F.col(us) < F.lit(first), SPLITS[0])
        .when(F.col(us) < F.lit(second), SPLITS[1])
        .otherwise(SPLITS[2])
    )


def assign_split(df: DataFrame, us: str, ratios: Sequence[float] = SPLIT_RATIOS) -> DataFrame:
    """Add the chronological ``split``."""
    return df.withColumn("split", split_column(us, split_cuts(df, us, ratios)))


def split_part(df: DataFrame, name: str) -> DataFrame:
    """Rows of one split."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}")
    return df.filter(F.col("split") == name)


def split_label_rates(df: DataFrame, horizons: Sequence[int] = HORIZONS_H) -> DataFrame:
    """Positive rate of each horizon in each split."""
    aggs = [
        F.avg(F.when(F.col("split") == s, F.col(f"label_incident_{h}h"))).alias(f"{s}_{h}")
        for h in horizons
        for s in SPLITS
    ]
    rows = {h: {s: F.round(F.col(f"{s}_{h}"), 4) for s in SPLITS} for h in horizons}
    return long_rows(df.agg(*aggs), rows, "horizon_h")


def _smd(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    pooled = F.sqrt((var_a + var_b) / 2)
    return F.when(pooled > 0, (mean_b - mean_a) / pooled).otherwise(F.lit(0.0))


def split_smd(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean per split and standardised test-train difference of each numeric column."""
    def part(fn, split: str, col: str) -> Column:
        return fn(F.when(F.col("split") == split, F.col(col).cast("double")))

    wide = df.agg(
        *[part(F.avg, s, c).alias(f"{s}_mean_{i}") for i, c in enumerate(cols) for s in SPLITS],
        *[part(F.var_samp, s, c).alias(f"{s}_var_{i}") for i, c in enumerate(cols) for s in ("train", "test")],
    )
    names = [*[f"{s}_mean" for s in SPLITS], "train_var", "test_var"]
    agg = long_rows(wide, {c: {n: F.col(f"{n}_{i}") for n in names} for i, c in enumerate(cols)}, "measure")
    smd = _smd(F.col("train_mean"), F.col("train_var"), F.col("test_mean"), F.col("test_var"))
    return agg.select(
        F.col("measure").alias("feature"),
        *[F.round(f"{s}_mean", 4).alias(f"{s}_mean") for s in SPLITS],
        F.round(smd, 4).alias("smd_train_test"),
    ).orderBy(F.abs("smd_train_test").desc(), "feature")


def split_shares(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of every category within each split, zero where it does not occur."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols]
    )
    counts = (
        df.select("split", F.inline(pairs))
        .filter("level is not null")
        .groupBy("feature", "level")
        .agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in SPLITS])
    )
    totals = counts.groupBy("feature").agg(*[F.sum(s).alias(f"_{s}") for s in SPLITS])
    return counts.join(totals, "feature").select(
        "feature",
        "level",
        *[
            F.round(F.coalesce(F.try_divide(F.col(s).cast("double"), F.col(f"_{s}")), F.lit(0.0)), 4)
            .alias(s)
            for s in SPLITS
        ],
    )


def chronological_index(df: DataFrame, us: str, ties: Sequence[str]) -> DataFrame:
    """Dense position in global time order (``ties`` settle equal instants)."""
    return number_order(df, [us, *ties])


def fold_starts(n: int, k: int) -> list[tuple[int, int, int]]:
    """(fold, first and end position of its validation part) of an expanding-window CV."""
    size = n // (k + 1)
    if size == 0:
        raise ValueError(f"too few rows ({n}) for {k} folds")
    return [(i, n - (k - i) * size, n - (k - i) * size + size) for i in range(k)]


def fold_blocks(indexed: DataFrame, folds: Sequence[tuple[int, int, int]], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates of the consecutive blocks that folds are made of, one row per (fold, role, block).

    The training part of fold f is blocks 0 to f, its validation part block f + 1; rows are read
    once, whatever the number of folds.
    """
    _, first, end = folds[0]
    i = F.col(IDX)
    block = F.when(i < first, 0).otherwise(1 + F.floor((i - first) / (end - first))).cast("int")
    blocks = indexed.groupBy(block.alias("block")).agg(*aggs)
    members = F.transform(
        F.sequence(F.greatest(F.col("block") - 1, F.lit(0)), F.lit(len(folds) - 1)),
        lambda f: F.struct(f.alias("fold"), F.when(F.col("block") == f + 1, "val").otherwise("train").alias("role")),
    )
    return blocks.filter(F.col("block") <= len(folds)).select("*", F.inline(members))


def fold_bounds(df: DataFrame, us: str, ties: Sequence[str], k: int) -> DataFrame:
    """Sizes and time limits of the k expanding folds."""
    indexed = chronological_index(df, us, ties)
    folds = fold_starts(indexed.count(), k)
    blocks = fold_blocks(indexed, folds, [F.count(F.lit(1)).alias("n"), F.min(us).alias("low"), F.max(us).alias("high")])

    def of(role: str, fn, col: str) -> Column:
        return fn(F.when(F.col("role") == role, F.col(col)))

    return blocks.groupBy("fold").agg(
        of("train", F.sum, "n").alias("n_train"),
        of("val", F.sum, "n").alias("n_val"),
        of("train", F.max, "high").alias("train_max_us"),
        of("val", F.min, "low").alias("val_min_us"),
        of("val", F.max, "high").alias("val_max_us"),
    )


def fold_smd(
    df: DataFrame, us: str, ties: Sequence[str], label: str, cols: Sequence[str], k: int
) -> DataFrame:
    """Per fold: sizes, positive rates, largest standardised difference and how many are notable."""
    indexed = chronological_index(df, us, ties)
    values = [label, *cols]
    folds = fold_starts(indexed.count(), k)
    blocks = fold_blocks(
        indexed,
        folds,
        [
            F.count(F.lit(1)).alias("n"),
            *[F.count(c).alias(f"n_{i}") for i, c in enumerate(values)],
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(values)],
            *[F.var_pop(c).alias(f"v_{i}") for i, c in enumerate(values)],
        ],
    )
    # k + 1 blocks: mean and spread of a part from those of its blocks
    part = Window.partitionBy("fold", "role")
    every = range(len(values))
    blocks = blocks.withColumns({f"mean_{i}": F.sum(F.col(f"n_{i}") * F.col(f"m_{i}")).over(part) / F.sum(f"n_{i}").over(part) for i in every})
    spread = lambda i: F.sum(F.col(f"n_{i}") * (F.col(f"v_{i}") + (F.col(f"m_{i}") - F.col(f"mean_{i}")) ** 2)) / F.sum(f"n_{i}")
    parts = blocks.groupBy("fold", "role").agg(
        F.sum("n").alias("n"), *[F.max(f"mean_{i}").alias(f"m_{i}") for i in every], *[spread(i).alias(f"v_{i}") for i in every]
    )
    roles = ("train", "val")

    def when(role: str, col: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(col)))

    agg = parts.groupBy("fold").agg(
        *[when(r, "n").alias(f"n_{r}") for r in roles],
        *[when(r, "m_0").alias(f"rate_{r}") for r in roles],
        *[when(r, f"m_{i}").alias(f"{c}_m_{r}") for r in roles for i, c in enumerate(cols, 1)],
        *[when(r, f"v_{i}").alias(f"{c}_v_{r}") for r in roles for i, c in enumerate(cols, 1)],
    )
    smds = F.array(
        *[
            F.struct(
                F.abs(
                    _smd(
                        F.col(f"{c}_m_train"),
                        F.col(f"{c}_v_train"),
                        F.col(f"{c}_m_val"),
                        F.col(f"{c}_v_val"),
                    )
                ).alias("smd"),
                F.lit(-i).alias("rank"),  # first column wins ties
                F.lit(c).alias("feature"),
            )
            for i, c in enumerate(cols)
        ]
    )
    top = F.array_max(smds)
    return agg.select(
        "fold",
        "n_train",
        "n_val",
        F.round("rate_train", 4).alias("pos_rate_train"),
        F.round("rate_val", 4).alias("pos_rate_val"),
        F.round(F.abs(F.col("rate_val") - F.col("rate_train")), 4).alias("pos_rate_abs_diff"),
        F.round(top["smd"], 4).alias("smd_abs_max"),
        top["feature"].alias("smd_max_feature"),
        F.size(F.filter(smds, lambda x: x["smd"] >= SMD_NOTABLE)).alias("n_features_smd_notable"),
    )

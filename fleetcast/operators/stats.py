"""Descriptive statistics and profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.operators.ordered import average_ranks, quantiles
from fleetcast.operators.radix import column_quantiles
from fleetcast.operators.reshape import long_rows, measures_long
from fleetcast.roles import PII_PATTERNS
from fleetcast.session import stage

_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max of each column."""
    kinds = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    # one row of all moments: columns are not turned into rows before they are aggregated
    wide = df.agg(*[fn(F.col(c).cast("double")).alias(f"{kind}_{i}") for i, c in enumerate(cols) for kind, fn in kinds.items()])
    found = column_quantiles(df, cols, _QUARTILES)
    facts = {
        c: {**{kind: F.col(f"{kind}_{i}") for kind in kinds}, **{q: F.lit(found[c][q]).cast("double") for q in _QUARTILES}} for i, c in enumerate(cols)
    }
    return long_rows(wide, facts, "measure")


def group_means(df: DataFrame, keys: Sequence[str | Column], cols: Sequence[str]) -> DataFrame:
    """Mean of each column per group."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def group_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean and sample std of a value per group, highest mean first."""
    return (
        df.groupBy(key)
        .agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
        )
        .orderBy(F.desc("mean"), key)
    )


def value_counts(df: DataFrame, cols: Sequence[str | Column], names: Sequence[str]) -> DataFrame:
    """(attribute, level, n) for several categorical columns in one pass."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("attribute"),
                (F.col(c) if isinstance(c, str) else c).cast("string").alias("level"),
            )
            for c, n in zip(cols, names)
        ]
    )
    return (
        df.select(F.inline(pairs))
        .filter("level is not null")
        .groupBy("attribute", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def in_order(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Sort by a fixed category order (unlisted levels last)."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), col)


def top_k(df: DataFrame, by: Column, k: int, tie: str) -> DataFrame:
    """The k first rows by an ordering, ties settled by name."""
    return df.orderBy(by.desc(), tie).limit(k)


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The k most frequent values."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, F.col("n"), k, col)


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations: (a, b, r) for every column pair."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    structs = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r"))
        for a, b in pairs
    ]
    return row.select(F.inline(F.array(*structs)))


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Spearman correlations with average ranks for ties.

    Equal value pairs merge first; each side is ranked on that merged table, so tied values
    never meet row by row.
    """
    structs = [
        F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            F.col(a).cast("double").alias("x"),
            F.col(b).cast("double").alias("y"),
        )
        for a, b in combinations(cols, 2)
    ]
    merged = (
        df.select(F.inline(F.array(*structs)))
        .filter("x is not null and y is not null")
        .groupBy("a", "b", "x", "y")
        .agg(F.count(F.lit(1)).alias("m"))
    )

    def ranks(side: str) -> DataFrame:
        # centred on the mean rank (n + 1) / 2
        return average_ranks(merged, ["a", "b"], side, count=F.col("m")).select(
            "a", "b", side, (F.col("avg_rank") - (F.col("n_total") + 1) / 2).alias(f"r_{side}")
        )

    joined = merged.join(ranks("x"), ["a", "b", "x"]).join(ranks("y"), ["a", "b", "y"])
    m, rx, ry = F.col("m"), F.col("r_x"), F.col("r_y")
    return joined.groupBy("a", "b").agg(
        F.try_divide(F.sum(m * rx * ry), F.sqrt(F.sum(m * rx * rx)) * F.sqrt(F.sum(m * ry * ry))).alias(
            "r"
        )
    )


def corr_with_label(df: DataFrame, cols: Sequence[str], label: str, k: int = 15) -> DataFrame:
    """The k features most correlated with a label, by absolute value."""
    row = df.agg(*[F.corr(c, label).alias(c) for c in cols])
    table = long_rows(row, {c: {"r": F.col(c)} for c in cols}, "feature")
    return top_k(table.filter("r is not null and not isnan(r)"), F.abs("r"), k, "feature")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column."""
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return long_rows(row, {c: {"n_null": F.col(c)} for c in df.columns}, "column")


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, non-null and distinct count of each column.

    Distinct counts come from one distinct pass over (column, value) pairs; ``approximate``
    uses sketches and a single aggregate instead.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if approximate:
        row = df.agg(
            *[F.count(c).alias(f"n_{c}") for c in df.columns],
            *[F.approx_count_distinct(c).alias(f"d_{c}") for c in df.columns],
        )
        return long_rows(
            row,
            {
                c: {
                    "type": F.lit(types[c]),
                    "non_null": F.col(f"n_{c}"),
                    "n_unique": F.col(f"d_{c}"),
                }
                for c in df.columns
            },
            "column",
        )
    structs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns
    ]
    per_value = (
        df.select(F.inline(F.array(*structs)))
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return per_value.groupBy("column").agg(
        F.first(F.element_at(names, F.col("column"))).alias("type"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("n_unique"),
    )


def daily_means(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """Daily mean series of each column."""
    return group_means(df, [F.to_date(ts).alias("jour")], cols)


def profile_zscore(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Group means centred and scaled over the groups (population std)."""
    means = measures_long(df, cols, [key]).groupBy("measure", key).agg(F.avg("value").alias("m"))
    # a profile has one row per hour or shift
    over = Window.partitionBy("measure")
    z = F.try_divide(F.col("m") - F.avg("m").over(over), F.stddev_pop("m").over(over))
    return means.select("measure", key, z.alias("z"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and largest value, empty bins left out."""
    ends = df.agg(
        *[F.min(c).cast("double").alias(f"{c}_lo") for c in cols],
        *[F.max(c).cast("double").alias(f"{c}_hi") for c in cols],
    ).first()
    structs = []
    for c in cols:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        step = None if lo is None else (hi - lo) / bins
        v = F.col(c).cast("double")
        spot = (
            F.least(F.floor((v - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(bins - 1))
            if step
            else F.when(v.isNotNull(), F.lit(0))
        )
        structs.append(
            F.struct(
                F.lit(c).alias("measure"),
                spot.alias("bin"),
                F.lit(lo).cast("double").alias("_lo"),
                F.lit(step).cast("double").alias("_step"),
            )
        )
    return (
        df.select(F.inline(F.array(*structs)))
        .filter("bin is not null")
        .groupBy("measure", "bin")
        .agg(
            (F.first("_lo") + F.col("bin") * F.first("_step")).alias("bin_start"),
            F.count(F.lit(1)).alias("n"),
        )
    )


#: rows of a group that one task takes for its box plot
GROUP_ROWS = 1 << 20


def boxplot(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Quartiles and whisker ends (last value within 1.5 IQR) per group and column.

    Groups of up to ``GROUP_ROWS`` rows move once, to the task that sorts their values; larger ones are
    bracketed by a sketch and ordered in chunks. Both are exact. Rows without a key are left out.
    """
    known = df.filter(F.col(key).isNotNull()).select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    sizes = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = stage(sizes.filter(F.col("_n") > GROUP_ROWS).select(key))
    whole = large.isEmpty()
    out = _boxes(known if whole else known.join(large, key, "left_anti"), key, cols)
    return out if whole else out.unionByName(_ordered_boxplot(known.join(large, key, "left_semi"), key, cols))


def _boxes(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Box plots of groups that fit one task."""
    begins = F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1
    numbered = df.select(F.col(key).alias("_key"), begins.alias("_start"), *[F.col(c).alias(f"_{j}") for j, c in enumerate(cols)])
    made = T.StructType(
        [T.StructField("measure", T.StringType()), T.StructField(key, df.schema[key].dataType)]
        + [T.StructField(n, T.DoubleType()) for n in (*_QUARTILES, "whisker_low", "whisker_high")]
    )
    return numbered.mapInArrow(group_boxes(list(cols), key), made)


def group_boxes(cols: Sequence[str], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partition function: rows of whole groups in (``_start`` marks the first of each), a row per group and column out.

    NaN counts as the largest value, as in Spark's order. Only the rows of the last, unfinished group are held.
    """

    def one(values: pa.ChunkedArray, group: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        valid = pc.is_valid(values).to_numpy()
        v, g = pc.fill_null(values, 0.0).to_numpy()[valid], group[valid]
        order = np.lexsort((v, g))
        v = v[order]
        found, n = np.unique(g, return_counts=True)
        at, begin = np.arange(len(v)), np.cumsum(n) - n
        of = np.repeat(np.arange(len(found)), n)
        quartiles = []
        with np.errstate(invalid="ignore"):
            for p in _QUARTILES.values():
                place = p * (n - 1)
                lo, hi = v[begin + np.floor(place).astype(np.int64)], v[begin + np.ceil(place).astype(np.int64)]
                quartiles.append(lo + (place - np.floor(place)) * (hi - lo))
            reach = 1.5 * (quartiles[2] - quartiles[0])
            low, high = (quartiles[0] - reach)[of], (quartiles[2] + reach)[of]
            above, below = (v >= low) | np.isnan(v), (v <= high) | np.isnan(high)
        if not len(found):
            return found, [pa.array([], pa.float64())] * 5
        first = np.minimum.reduceat(np.where(above, at, len(v)), begin)
        last = np.maximum.reduceat(np.where(below, at, -1), begin)
        ends = [pa.array(v[np.clip(i, 0, len(v) - 1)], mask=(i < 0) | (i == len(v))) for i in (first, last)]
        return found, [*[pa.array(q) for q in quartiles], *ends]

    def boxes(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        begins = rows["_start"].to_numpy()
        group, keys = np.cumsum(begins) - 1, rows["_key"].filter(pa.array(begins)).combine_chunks()
        for j, c in enumerate(cols):
            found, columns = one(rows[f"_{j}"], group)
            names = ["measure", key, *_QUARTILES, "whisker_low", "whisker_high"]
            yield pa.record_batch([pa.array([c] * len(found), pa.string()), keys.take(pa.array(found)), *columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_start").to_numpy(zero_copy_only=False))
            if len(starts) and (held or starts[-1]):
                yield from boxes([*held, batch.slice(0, starts[-1])])
                held, batch = [], batch.slice(starts[-1])
            if batch.num_rows:
                held.append(batch)
        if held:
            yield from boxes(held)

    return run


def _ordered_boxplot(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Box plots of groups of any size."""
    long = measures_long(df, cols, [key])
    q = quantiles(long, ["measure", key], "value", _QUARTILES).drop("n")
    iqr = F.col("q3") - F.col("q1")
    v = F.col("value")
    # conditional extremes merge on the map side; the quartile table has one row per group
    return (
        long.filter("value is not null").join(q, ["measure", key])
        .groupBy("measure", key)
        .agg(
            *[F.max(c).alias(c) for c in _QUARTILES],
            F.min(F.when(v >= F.col("q1") - 1.5 * iqr, v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("q3") + 1.5 * iqr, v)).alias("whisker_high"),
        )
    )


def counts_by(df: DataFrame, periods: dict[str, Column], value: str | None = None) -> DataFrame:
    """(period, level, n, mean of value) for several groupings in one pass."""
    structs = [
        F.struct(F.lit(n).alias("period"), c.cast("string").alias("level"))
        for n, c in periods.items()
    ]
    keep = [value] if value else []
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias(f"mean_{value}"))
    return (
        df.select(*keep, F.inline(F.array(*structs)))
        .filter("level is not null")
        .groupBy("period", "level")
        .agg(*aggs)
    )


def determinism(df: DataFrame, given: str, result: str) -> DataFrame:
    """Does one column determine another? Distinct, missing and ambiguous values."""
    pairs = df.groupBy(given, result).agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy(given).agg(
        F.count(result).alias("results"), F.sum("n").alias("n")
    )
    known = F.col(given).isNotNull()
    return per.agg(
        F.count(F.when(known, 1)).alias("n_distinct"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_null"),
        F.count(F.when(known & (F.col("results") > 1), 1)).alias("n_ambiguous"),
        F.coalesce(F.max(F.when(known, F.col("results"))), F.lit(0)).alias("max_results"),
    )


def pivot_means(
    df: DataFrame, keys: Sequence[str], by: str, values: Sequence, value: str
) -> DataFrame:
    """Mean of a value per key and category, one column per known category."""
    return df.groupBy(*keys).pivot(by, list(values)).agg(F.avg(value))


def null_cells(df: DataFrame) -> Column:
    """Aggregate: missing cells over all columns."""
    return reduce(lambda a, b: a + b, [F.count(F.when(F.col(c).isNull(), 1)) for c in df.columns])


def incident_metrics(df: DataFrame, machine: str = "machine_id") -> DataFrame:
    """Rows, columns, machines, missing cells and mean confidence of scored reports."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count_distinct(machine).alias("n_machines"),
        null_cells(df).alias("n_null"),
        F.round(F.avg("confidence"), 3).alias("mean_confidence"),
    )


def personal_columns(df: DataFrame) -> list[str]:
    """Columns whose name looks like personal data."""
    return [c for c in df.columns if any(p in c.lower() for p in PII_PATTERNS)]

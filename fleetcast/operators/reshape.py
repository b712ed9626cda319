"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measures_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., measure, value) in one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return df.select(*keep, F.inline(pairs))


def long_rows(one_row: DataFrame, rows: Mapping[str, Mapping[str, Column]], name: str) -> DataFrame:
    """Turn a one-row aggregate into one row per entry of ``rows``."""
    structs = [
        F.struct(F.lit(key).alias(name), *[c.alias(n) for n, c in cols.items()])
        for key, cols in rows.items()
    ]
    return one_row.select(F.inline(F.array(*structs)))


def sensor_measurements(
    clean: DataFrame, sensors: Mapping[str, int], keep: Sequence[str] = ("reading_id",)
) -> DataFrame:
    """One row per (reading, sensor) with the value and its three quality marks."""
    structs = [
        F.struct(
            F.lit(sid).alias("sensor_id"),
            F.col(s).alias("value"),
            *[F.col(f"{s}_{m}").alias(m) for m in ("was_imputed", "is_outlier", "is_saturated")],
        )
        for s, sid in sensors.items()
    ]
    return clean.select(*keep, F.inline(F.array(*structs)))


def repivot(
    header: DataFrame,
    measurement: DataFrame,
    names: Mapping[int, str],
    marks: Sequence[str] = ("was_imputed", "is_outlier", "is_saturated"),
    key: str = "reading_id",
) -> DataFrame:
    """Long measurements back to one column per sensor (and mark), left-joined to the header.

    The sensor list is known, so one grouped aggregate does it without a scan for values.
    """
    aggs = []
    for sid, name in names.items():
        here = F.col("sensor_id") == sid
        aggs.append(F.max(F.when(here, F.col("value"))).alias(name))
        aggs += [F.max(F.when(here, F.col(m))).alias(f"{name}_{m}") for m in marks]
    return header.join(measurement.groupBy(key).agg(*aggs), key, "left")


def active_flags(
    df: DataFrame, flags: Sequence[str], keep: Sequence[str], name: str = "type_panne"
) -> DataFrame:
    """One row per (row, flag equal to 1), flag names without their ``type_`` prefix."""
    structs = [
        F.struct(F.lit(f).alias(name), F.col(f).alias("_on")) for f in flags
    ]
    long = df.select(*keep, F.inline(F.array(*structs))).filter("_on = 1").drop("_on")
    return long.withColumn(name, F.regexp_replace(name, "^type_", ""))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts per pair of categories, long form (pairs with a missing side are left out)."""
    return (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def month_counts(df: DataFrame, ts: str, by: str, values: Sequence[str]) -> DataFrame:
    """Rows per month and category, one zero-filled column per known category."""
    return (
        df.groupBy(F.date_format(ts, "yyyy-MM").alias("month"))
        .pivot(by, list(values))
        .count()
        .na.fill(0)
    )

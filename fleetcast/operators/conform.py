"""Row-level conformance: identifiers, dimensions, surrogate keys, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.functions.incident import confidence_columns, dominant_signal, signal_count
from fleetcast.functions.time import date_and_clock, iso_week, time_axes
from fleetcast.operators.ordered import IDX, number_order, quantiles
from fleetcast.roles import (
    CAPACITY_RATIO_TOLERANCE,
    INCIDENT_SIGNALS,
    OPERATOR_PII_COLUMNS,
    PII_PATTERNS,
    SENSOR_UNITS,
)

AUDIT_COLUMNS = ("created_at", "updated_at")


def drop_identifiers(df: DataFrame, columns: Sequence[str] = OPERATOR_PII_COLUMNS) -> DataFrame:
    """Remove direct identifiers (absent columns are fine)."""
    return df.drop(*columns)


def drop_technical(df: DataFrame, *more: str) -> DataFrame:
    """Remove audit columns and any named technical column."""
    return df.drop(*AUDIT_COLUMNS, *more)


def pii_scan(df: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """One row per column: does its name look like personal data?"""
    rows = [
        (c, c not in allow and any(p in c.lower() for p in PII_PATTERNS)) for c in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, "column string, is_pii boolean")


def column_roles(
    df: DataFrame,
    target: str,
    excluded: Sequence[str],
    categorical: Sequence[str],
) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature columns, without identifiers, labels and leaks."""
    out = {target, *excluded}
    numeric = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in out
    ]
    return numeric, [c for c in categorical if c in df.columns and c not in out]


def surrogate_dimension(df: DataFrame, name: str, key: str, label: str = "name") -> DataFrame:
    """Sorted distinct values numbered 1..N."""
    values = df.select(F.col(name).alias(label)).filter(F.col(label).isNotNull()).distinct()
    return number_order(values, [label]).select((F.col(IDX) + 1).alias(key), label)


def number_rows(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Dense 1..N id in the order of ``by`` (which should be unique)."""
    return number_order(df, by).withColumn(key, F.col(IDX) + 1).drop(IDX)


def sensor_dimension(spark: SparkSession, units: Mapping[str, str] = SENSOR_UNITS) -> DataFrame:
    """Constant sensor dimension: a sensor is a row."""
    rows = [(i, name, unit) for i, (name, unit) in enumerate(units.items(), 1)]
    return spark.createDataFrame(rows, "sensor_id int, name string, unit string")


def lookup_key(df: DataFrame, dim: DataFrame, business: str, dim_business: str, key: str) -> DataFrame:
    """Business key to surrogate key; unknown keys become NULL."""
    pairs = dim.select(F.col(dim_business).alias("_business"), key)
    return df.join(pairs, df[business] == pairs["_business"], "left").drop("_business")


def capacity_ratio_median(machine: DataFrame) -> float | None:
    """Median of daily over hourly capacity: one scalar."""
    ratio = F.col("max_daily_capacity") / F.col("max_hourly_capacity_pieces")
    one = machine.select(F.lit(0).alias("_all"), ratio.alias("ratio"))
    row = quantiles(one, ["_all"], "ratio", {"mid": 0.5}).first()
    return None if row is None else row["mid"]


def capacity_columns(median: float | None) -> dict[str, Column]:
    """Equivalent hours per day and the mark of machines far from the fleet median."""
    ratio = F.col("max_daily_capacity") / F.col("max_hourly_capacity_pieces")
    return {
        "heures_equivalentes_jour": F.bround(ratio).cast("int"),
        "capacite_incoherente": F.abs(ratio - F.lit(median)) > CAPACITY_RATIO_TOLERANCE,
    }


def machine_dimension(machine: DataFrame, model_dim: DataFrame) -> DataFrame:
    """Machines numbered by code, with model key and capacity checks."""
    checked = drop_technical(machine).withColumns(capacity_columns(capacity_ratio_median(machine)))
    keyed = lookup_key(checked, model_dim, "model", "name", "model_id").drop("model")
    return number_rows(keyed, ["machine_code"], "machine_pk")


def enrich_telemetry(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Day, hour, weekday and shift of every reading."""
    return df.withColumns(time_axes(ts))


def enrich_incidents(
    df: DataFrame, flags: Sequence[str] = INCIDENT_SIGNALS, date: str = "date", clock: str = "time"
) -> DataFrame:
    """Signals, event time assembled from date and clock, day, ISO week and weekday."""
    timed = df.withColumns(
        {
            "n_signals": signal_count(flags),
            "signal": dominant_signal(flags),
            "dt": date_and_clock(F.col(date), F.col(clock)),
        }
    )
    dt = F.col("dt")
    return timed.withColumns(
        {
            "jour": F.to_date(dt),
            "semaine_iso": F.when(dt.isNotNull(), iso_week(dt)),
            "weekday": F.date_format(dt, "EEEE"),
        }
    )


def report_confidence(df: DataFrame, **columns: str) -> DataFrame:
    """Confidence index of each report and its components."""
    return df.withColumns(confidence_columns(**columns))

"""Clean layer: telemetry without duplicates or gaps, normalised tables, metrics."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcast.functions.time import micros, naive_utc
from fleetcast.operators.conform import (
    drop_identifiers,
    drop_technical,
    enrich_incidents,
    lookup_key,
    machine_dimension,
    number_rows,
    report_confidence,
    sensor_dimension,
    surrogate_dimension,
)
from fleetcast.operators.ordered import CHUNK
from fleetcast.operators.quality import dedup_first, flag_outliers, flag_saturation, interpolate
from fleetcast.operators.reshape import sensor_measurements
from fleetcast.operators.timeline import CONTEXT, STEP, context_chunks, event_context
from fleetcast.roles import HOUR_US, INCIDENT_SIGNALS, SENSOR_UNITS, Roles
from fleetcast.session import stage


def clean_telemetry(
    readings: DataFrame,
    incidents: DataFrame,
    maintenance: DataFrame,
    roles: Roles,
    width: Mapping[str, float] | float = 1.0,
    *,
    wanted: Collection[str] = CONTEXT,
) -> DataFrame:
    """Readings with event context (the ``wanted`` lookups, segment and membership among them), filled gaps and quality marks.

    ``readings`` must be unique per (entity, time). The filled table is staged: the outlier
    and saturation statistics each read it again.
    """
    context = event_context(readings, incidents, maintenance, roles.entity, wanted=wanted, keep_chunks=True)
    filled = stage(interpolate(context_chunks(context, roles), roles))
    return flag_saturation(flag_outliers(filled, roles.sensors), roles.sensors, width)


def clean_metrics(clean: DataFrame, roles: Roles, n_duplicates: int | None = None) -> DataFrame:
    """Rows, maintenance rows and per-sensor counts of filled, marked and missing values."""
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(roles.during).cast("long")).alias("n_during_maintenance"),
    ]
    if n_duplicates is not None:
        aggs.append(F.lit(n_duplicates).alias("n_duplicates_removed"))
    for s in roles.sensors:
        for mark, name in (
            ("was_imputed", "imputed"),
            ("is_outlier", "outlier"),
            ("is_saturated", "saturated"),
        ):
            aggs.append(F.sum(F.col(f"{s}_{mark}").cast("long")).alias(f"n_{name}_{s}"))
        aggs.append(F.sum(F.col(s).isNull().cast("long")).alias(f"n_null_{s}"))
    return clean.agg(*aggs)


def build_silver(
    bronze: Mapping[str, DataFrame],
    roles: Roles = Roles(),
    flags: Sequence[str] = INCIDENT_SIGNALS,
    ties: Sequence[str] = ("telemetry_id",),
) -> dict[str, DataFrame]:
    """Normalised tables from the four raw tables (machine, maintenance, telemetry, incident)."""
    spark = bronze["machine"].sparkSession
    raw_machine = bronze["machine"].withColumn("commissioning_date", naive_utc("commissioning_date"))
    model = stage(surrogate_dimension(raw_machine, "model", "model_id"))
    sensor = sensor_dimension(spark, {s: SENSOR_UNITS.get(s, "") for s in roles.sensors})
    machine = stage(machine_dimension(raw_machine, model))
    component = stage(surrogate_dimension(bronze["maintenance"], "component", "component_id"))

    maint = drop_technical(bronze["maintenance"], "action_type").withColumns(
        {
            "duration_hours": F.col("duration_hours").cast("double"),
            "maintenance_at": naive_utc("maintenance_at"),
        }
    )
    windows = maint.select(
        F.col("machine_code").alias(roles.entity),
        micros("maintenance_at").alias("us"),
        (micros("maintenance_at") + F.round(F.col("duration_hours") * HOUR_US).cast("long")).alias(
            "end_us"
        ),
    )
    maintenance = lookup_key(maint, component, "component", "name", "component_id")
    maintenance = lookup_key(maintenance, machine, "machine_code", "machine_code", "machine_pk")

    telemetry = bronze["telemetry"].withColumn("timestamp", naive_utc("timestamp"))
    # staged, since an order samples its input before it moves it
    unique = stage(dedup_first(telemetry, [roles.entity, "timestamp"], ties).drop(*ties))
    no_incidents = windows.select(roles.entity, "us").limit(0)
    clean = clean_telemetry(
        unique.withColumn("us", micros("timestamp")), no_incidents, windows, roles, wanted=(roles.segment, roles.during)
    )
    # the numbered rows are staged in their order chunks
    clean = number_rows(clean.drop(CHUNK, STEP, roles.segment), [roles.entity, "us"], "reading_id")
    header = lookup_key(clean, machine, roles.entity, "machine_code", "machine_pk")
    reading = header.select(
        "reading_id", "machine_pk", "timestamp", roles.during, roles.production
    )
    measurement = sensor_measurements(clean, {s: i for i, s in enumerate(roles.sensors, 1)})

    incident = report_confidence(enrich_incidents(drop_identifiers(bronze["incident"]), flags))
    incident = lookup_key(incident, machine, "machine_id", "machine_code", "machine_pk")
    incident = incident.withColumnRenamed("dt", "timestamp").drop(
        "date", "time", "machine_id", "incident_pk"
    )
    return {
        "model": model,
        "sensor": sensor,
        "component": component,
        "machine": machine,
        "maintenance": maintenance.drop("component", "machine_code"),
        "reading": reading,
        "measurement": measurement,
        "incident": incident,
    }

"""Queries over the event time line: membership, as-of lookups, counts, labels."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession

from fleetcast.operators.timeline import CONTEXT, add_history, add_labels, event_context
from fleetcast.queries.base import (
    LOG_SQL,
    SEGMENT_SQL,
    log_incidents,
    log_maintenance,
    log_readings,
    query,
    rounded,
)


def context(spark: SparkSession, sf: str, *payload: str, wanted: Collection[str] = CONTEXT, keep_chunks: bool = False) -> DataFrame:
    """Readings (only the payload a query needs) with their event context (only the lookups it needs)."""
    cols = ["event_id", "user_id", "us", *payload]
    return event_context(
        log_readings(spark, sf).select(*cols),
        log_incidents(spark, sf).select("user_id", "us"),
        log_maintenance(spark, sf),
        "user_id",
        wanted=wanted,
        keep_chunks=keep_chunks,
    )


@query("segments", f"WITH {SEGMENT_SQL} SELECT event_id, segment FROM located")
def segments(spark, sf):
    return context(spark, sf, wanted=["segment"]).select("event_id", "segment")


@query(
    "during_interval",
    f"WITH {SEGMENT_SQL} SELECT event_id, during_maintenance FROM located",
)
def during_interval(spark, sf):
    return context(spark, sf, wanted=["during_maintenance"]).select("event_id", "during_maintenance")


@query(
    "asof_last_maintenance",
    f"""WITH {LOG_SQL},
    prev AS (
      SELECT r.event_id, r.us, m.us AS start_us, m.end_us
      FROM readings r ASOF LEFT JOIN maintenance m ON r.user_id = m.user_id AND r.us >= m.us)
    SELECT event_id, start_us AS last_start_us, end_us AS last_end_us,
      round(CASE WHEN end_us IS NULL THEN NULL
            ELSE greatest(us - end_us, 0) / 3600000000.0 END, 6) AS time_since_last_maintenance_h
    FROM prev""",
)
def asof_last_maintenance(spark, sf):
    out = add_history(context(spark, sf, wanted=["last_start_us", "last_end_us"])).select(
        "event_id", "last_start_us", "last_end_us", "time_since_last_maintenance_h"
    )
    return rounded(out, "time_since_last_maintenance_h")


@query(
    "asof_last_incident",
    f"""WITH {LOG_SQL}
    SELECT r.event_id, i.us AS last_incident_us,
      round((r.us - i.us) / 3600000000.0, 6) AS time_since_last_incident_h
    FROM readings r ASOF LEFT JOIN incidents i ON r.user_id = i.user_id AND r.us > i.us""",
)
def asof_last_incident(spark, sf):
    out = add_history(context(spark, sf, wanted=["last_incident_us"])).select(
        "event_id", "last_incident_us", "time_since_last_incident_h"
    )
    return rounded(out, "time_since_last_incident_h")


@query(
    "event_counts",
    f"""WITH {LOG_SQL}
    SELECT r.event_id,
      (SELECT count(*) FROM incidents i WHERE i.user_id = r.user_id
        AND i.us < r.us AND i.us >= r.us - 604800000000) AS n_incidents_7d,
      (SELECT count(*) FROM incidents i WHERE i.user_id = r.user_id
        AND i.us < r.us AND i.us >= r.us - 2592000000000) AS n_incidents_30d,
      (SELECT count(*) FROM maintenance m WHERE m.user_id = r.user_id
        AND m.us < r.us AND m.us >= r.us - 2592000000000) AS n_maintenance_30d
    FROM readings r""",
)
def event_counts(spark, sf):
    counts = ["n_incidents_7d", "n_incidents_30d", "n_maintenance_30d"]
    return context(spark, sf, wanted=counts).select("event_id", *counts)


_NEXT_SQL = (
    LOG_SQL
    + """,
nexts AS (
  SELECT r.event_id, r.us, i.us AS next_us
  FROM readings r ASOF LEFT JOIN incidents i ON r.user_id = i.user_id AND r.us < i.us)
"""
)


@query(
    "rul",
    f"""WITH {_NEXT_SQL}
    SELECT event_id, round((next_us - us) / 3600000000.0, 6) AS rul_hours,
      CAST(next_us IS NULL AS INTEGER) AS rul_censored FROM nexts""",
)
def rul(spark, sf):
    out = add_labels(context(spark, sf, wanted=["next_incident_us"])).select("event_id", "rul_hours", "rul_censored")
    return rounded(out, "rul_hours")


@query(
    "labels_multi_horizon",
    f"""WITH {LOG_SQL}
    SELECT r.event_id, """
    + ", ".join(
        f"""CAST(EXISTS (SELECT 1 FROM incidents i WHERE i.user_id = r.user_id AND i.us > r.us
        AND i.us <= r.us + {h} * 3600000000) AS INTEGER) AS label_incident_{h}h"""
        for h in (6, 12, 24, 48)
    )
    + " FROM readings r",
)
def labels_multi_horizon(spark, sf):
    out = add_labels(context(spark, sf, wanted=["next_incident_us"]))
    return out.select("event_id", *[f"label_incident_{h}h" for h in (6, 12, 24, 48)])


@query(
    "history_features",
    f"""WITH {LOG_SQL},
    prev AS (
      SELECT r.event_id, r.user_id, r.us, m.end_us
      FROM readings r ASOF LEFT JOIN maintenance m ON r.user_id = m.user_id AND r.us >= m.us),
    both_prev AS (
      SELECT p.*, i.us AS inc_us
      FROM prev p ASOF LEFT JOIN incidents i ON p.user_id = i.user_id AND p.us > i.us)
    SELECT event_id,
      round(CASE WHEN end_us IS NULL THEN NULL
            ELSE greatest(us - end_us, 0) / 3600000000.0 END, 6) AS time_since_last_maintenance_h,
      round((us - inc_us) / 3600000000.0, 6) AS time_since_last_incident_h,
      (SELECT count(*) FROM incidents i WHERE i.user_id = b.user_id
        AND i.us < b.us AND i.us >= b.us - 604800000000) AS n_incidents_7d,
      (SELECT count(*) FROM incidents i WHERE i.user_id = b.user_id
        AND i.us < b.us AND i.us >= b.us - 2592000000000) AS n_incidents_30d,
      (SELECT count(*) FROM maintenance m WHERE m.user_id = b.user_id
        AND m.us < b.us AND m.us >= b.us - 2592000000000) AS n_maintenance_30d
    FROM both_prev b""",
)
def history_features(spark, sf):
    past = ["last_end_us", "last_incident_us", "n_incidents_7d", "n_incidents_30d", "n_maintenance_30d"]
    out = add_history(context(spark, sf, wanted=past)).select(
        "event_id",
        "time_since_last_maintenance_h",
        "time_since_last_incident_h",
        "n_incidents_7d",
        "n_incidents_30d",
        "n_maintenance_30d",
    )
    return rounded(out, "time_since_last_maintenance_h", "time_since_last_incident_h")

"""Incident reports: enrichment, confidence, associations, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.functions.time import iso_week, micros, naive_utc
from fleetcast.operators import stats
from fleetcast.operators.association import chi2_cramer as chi2, kruskal as kruskal_test
from fleetcast.operators.checks import bad_flag_values, check_binary_flags, check_range, check_shifts
from fleetcast.operators.conform import drop_identifiers, enrich_incidents, enrich_telemetry, report_confidence
from fleetcast.operators.reshape import active_flags, contingency as cross_counts
from fleetcast.queries.base import REPORT_FLAGS, REPORTS_SQL, query, reports, rounded
from fleetcast.sources.tables import read_table

ENRICH_SQL = (
    REPORTS_SQL
    + """,
enriched AS (
  SELECT *, type_heat + type_pressure + type_noise AS n_signals,
    CASE (type_heat = 1)::INT + (type_pressure = 1)::INT + (type_noise = 1)::INT
      WHEN 0 THEN 'aucun'
      WHEN 1 THEN CASE WHEN type_heat = 1 THEN 'type_heat' WHEN type_pressure = 1 THEN 'type_pressure'
        ELSE 'type_noise' END
      ELSE 'multiple' END AS signal,
    try_cast(date || ' ' || time AS TIMESTAMP) AS dt
  FROM reports),
scored AS (
  SELECT *, CASE WHEN n_signals = 1 THEN 1.0 WHEN n_signals > 1 THEN 0.5 ELSE 0.0 END AS coherence,
    CASE WHEN comment IS NOT NULL THEN 1.0 ELSE 0.0 END AS comment_present,
    CASE WHEN regexp_full_match(machine_id, 'MACH-\\d+') THEN 1.0 ELSE 0.0 END AS machine_valide,
    CASE WHEN severity BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END AS severity_valide
  FROM enriched),
confident AS (
  SELECT *, CAST(round(0.4 * coherence + 0.2 * comment_present + 0.2 * machine_valide
    + 0.2 * severity_valide, 3) AS DOUBLE) AS confidence FROM scored)
"""
)


def enriched(spark, sf):
    return enrich_incidents(drop_identifiers(reports(spark, sf)), REPORT_FLAGS)


@query(
    "pii_drop",
    f"WITH {REPORTS_SQL} SELECT * EXCLUDE (operator_name, operator_badge) FROM reports",
)
def pii_drop(spark, sf):
    return drop_identifiers(reports(spark, sf))


@query(
    "enrich_incident",
    f"""WITH {ENRICH_SQL} SELECT incident_id, CAST(n_signals AS INTEGER) AS n_signals, signal, dt,
    CAST(dt AS DATE) AS jour,
    CASE WHEN dt IS NULL THEN NULL ELSE printf('%04d-S%02d', isoyear(dt), week(dt)) END AS semaine_iso,
    dayname(dt) AS weekday FROM enriched""",
)
def enrich_incident(spark, sf):
    return enriched(spark, sf).select(
        "incident_id", "n_signals", "signal", "dt", "jour", "semaine_iso", "weekday"
    )


@query(
    "incident_confidence",
    f"""WITH {ENRICH_SQL} SELECT incident_id, CAST(coherence AS DOUBLE) AS coherence,
    CAST(comment_present AS DOUBLE) AS comment_present, CAST(machine_valide AS DOUBLE) AS machine_valide,
    CAST(severity_valide AS DOUBLE) AS severity_valide, confidence FROM confident""",
)
def incident_confidence(spark, sf):
    return report_confidence(enriched(spark, sf)).select(
        "incident_id", "coherence", "comment_present", "machine_valide", "severity_valide", "confidence"
    )


LONG_SQL = (
    REPORTS_SQL
    + """,
long AS (SELECT machine_id, severity, CASE WHEN severity IS NOT NULL THEN least(severity, 3) END AS sev_grp, 'heat' AS type_panne FROM reports WHERE type_heat = 1
  UNION ALL SELECT machine_id, severity, CASE WHEN severity IS NOT NULL THEN least(severity, 3) END, 'pressure' FROM reports WHERE type_pressure = 1
  UNION ALL SELECT machine_id, severity, CASE WHEN severity IS NOT NULL THEN least(severity, 3) END, 'noise' FROM reports WHERE type_noise = 1)
"""
)


def long_reports(spark, sf):
    long = active_flags(reports(spark, sf), REPORT_FLAGS, ["machine_id", "severity"])
    # levels 3 and above form one group, which keeps expected counts high
    return long.withColumn("sev_grp", F.when(F.col("severity").isNotNull(), F.least("severity", F.lit(3))))


@query(
    "sev_by_type",
    f"""WITH {LONG_SQL} SELECT type_panne, count(severity) AS count, round(avg(severity), 6) AS mean,
    round(stddev_samp(severity), 6) AS std FROM long GROUP BY type_panne""",
)
def sev_by_type(spark, sf):
    return rounded(stats.group_summary(long_reports(spark, sf), "type_panne", "severity"), "mean", "std")


@query(
    "sev_by_machine",
    f"""WITH {REPORTS_SQL} SELECT machine_id, count(severity) AS count, round(avg(severity), 6) AS mean,
    round(stddev_samp(severity), 6) AS std FROM reports GROUP BY machine_id""",
)
def sev_by_machine(spark, sf):
    return rounded(stats.group_summary(reports(spark, sf), "machine_id", "severity"), "mean", "std")


@query(
    "contingency",
    f"""WITH {LONG_SQL} SELECT type_panne, sev_grp, count(*) AS n FROM long
    WHERE sev_grp IS NOT NULL GROUP BY ALL""",
)
def contingency(spark, sf):
    return cross_counts(long_reports(spark, sf), "type_panne", "sev_grp")


def _tail_sql(x: str, dof: str) -> str:
    """Upper tail of a chi-square distribution with an even number of degrees of freedom."""
    return f"""round((SELECT sum(exp(CASE WHEN i = 0 THEN 0 ELSE i * ln(({x}) / 2) - lgamma(i + 1) END - ({x}) / 2))
      FROM range(CAST(({dof}) / 2 AS BIGINT)) AS q(i)), 6)"""


def _chi2_sql(a: str, b: str) -> str:
    return f"""o AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM long
      WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
    ra AS (SELECT a, sum(n) AS r FROM o GROUP BY a), cb AS (SELECT b, sum(n) AS c FROM o GROUP BY b),
    tot AS (SELECT sum(n) AS t, count(DISTINCT a) AS nr, count(DISTINCT b) AS nc FROM o),
    grid AS (SELECT coalesce(n, 0) AS n, r * c / CAST(t AS DOUBLE) AS e, t, nr, nc
      FROM ra, cb, tot LEFT JOIN o ON o.a = ra.a AND o.b = cb.b),
    x AS (SELECT any_value(t) AS t, any_value(nr) AS nr, any_value(nc) AS nc, sum((n - e) * (n - e) / e) AS chi2,
      count(*) FILTER (WHERE e < 5) AS low FROM grid)
    SELECT CAST(t AS BIGINT) AS n, round(chi2, 6) AS chi2, CAST((nr - 1) * (nc - 1) AS INTEGER) AS dof,
      round(sqrt(greatest(0, chi2 / t - (nr - 1) * (nc - 1) / (t - 1)) /
        least(nr - (nr - 1) * (nr - 1) / (t - 1) - 1, nc - (nc - 1) * (nc - 1) / (t - 1) - 1)), 6) AS cramers_v,
      low AS n_low_expected, {_tail_sql("chi2", "(nr - 1) * (nc - 1)")} AS p_chi2 FROM x"""


@query("chi2_cramer", f"WITH {LONG_SQL}, {_chi2_sql('type_panne', 'sev_grp')}")
def chi2_cramer(spark, sf):
    out = chi2(long_reports(spark, sf), "type_panne", "sev_grp")
    return rounded(out, "chi2", "cramers_v", "p_chi2")


@query("chi2_machine_type", f"WITH {LONG_SQL}, {_chi2_sql('machine_id', 'type_panne')}")
def chi2_machine_type(spark, sf):
    out = chi2(long_reports(spark, sf), "machine_id", "type_panne")
    return rounded(out, "chi2", "cramers_v", "p_chi2")


def _kruskal_sql(source: str, group: str) -> str:
    return f"""r AS (SELECT {group} AS g, severity, rank() OVER (ORDER BY severity)
        + (count(*) OVER (PARTITION BY severity) - 1) / 2.0 AS rk
      FROM {source} WHERE severity IS NOT NULL AND {group} IS NOT NULL),
    s AS (SELECT g, count(*) AS n, sum(rk) AS sr FROM r GROUP BY g),
    t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY severity)),
    h AS (SELECT sum(n) AS n, count(*) AS k, any_value(ties) AS ties,
      sum(n * (sr / n - (tot + 1) / 2.0) * (sr / n - (tot + 1) / 2.0)) AS ss
      FROM s, t, (SELECT count(*) AS tot FROM r)),
    f AS (SELECT n, k, 12 * ss / (CAST(n AS DOUBLE) * (n + 1)) /
      (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS hh FROM h)
    SELECT CAST(n AS BIGINT) AS n, k, round(hh, 6) AS kruskal_h, round((hh - k + 1) / (n - k), 6) AS epsilon2,
      {_tail_sql("hh", "k - 1")} AS p_kruskal FROM f"""


@query("kruskal", f"WITH {LONG_SQL}, {_kruskal_sql('long', 'type_panne')}")
def kruskal(spark, sf):
    out = kruskal_test(long_reports(spark, sf), "type_panne", "severity")
    return rounded(out, "kruskal_h", "epsilon2", "p_kruskal")


@query("kruskal_machine", f"WITH {REPORTS_SQL}, {_kruskal_sql('reports', 'machine_id')}")
def kruskal_machine(spark, sf):
    out = kruskal_test(reports(spark, sf), "machine_id", "severity")
    return rounded(out, "kruskal_h", "epsilon2", "p_kruskal")


@query(
    "counts_by_period",
    f"WITH {ENRICH_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{name}' AS period, {expr} AS level, count(*) AS n, round(avg(confidence), 6) AS mean_confidence
        FROM confident WHERE {expr} IS NOT NULL GROUP BY 2"""
        for name, expr in {
            "day": "CAST(CAST(dt AS DATE) AS VARCHAR)",
            "week": "CASE WHEN dt IS NULL THEN NULL ELSE printf('%04d-S%02d', isoyear(dt), week(dt)) END",
            "shift": "shift",
            "signal": "signal",
            "machine": "machine_id",
        }.items()
    ),
)
def counts_by_period(spark, sf):
    out = stats.counts_by(
        report_confidence(enriched(spark, sf)),
        {
            "day": F.col("jour"),
            "week": F.col("semaine_iso"),
            "shift": F.col("shift"),
            "signal": F.col("signal"),
            "machine": F.col("machine_id"),
        },
        "confidence",
    )
    return rounded(out, "mean_confidence")


@query(
    "null_counts",
    f"WITH {ENRICH_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM enriched"
        for c in ("incident_id", "severity", "comment", "dt", "shift", "machine_id")
    ),
)
def null_counts(spark, sf):
    return stats.null_counts(
        enriched(spark, sf).select("incident_id", "severity", "comment", "dt", "shift", "machine_id")
    )


@query(
    "incident_metrics",
    f"""WITH {ENRICH_SQL} SELECT count(*) AS n_rows, 7 AS n_columns, count(DISTINCT machine_id) AS n_machines,
    count(*) FILTER (WHERE severity IS NULL) + count(*) FILTER (WHERE comment IS NULL)
      + count(*) FILTER (WHERE dt IS NULL) AS n_null,
    round(avg(confidence), 3) AS mean_confidence FROM confident""",
)
def incident_metrics(spark, sf):
    made = report_confidence(enriched(spark, sf)).select(
        "incident_id", "machine_id", "severity", "comment", "dt", "signal", "confidence"
    )
    return stats.incident_metrics(made)


@query(
    "check_range_rule",
    f"""WITH {REPORTS_SQL} SELECT min(severity) AS min, max(severity) AS max,
    count(*) FILTER (WHERE severity NOT BETWEEN 1 AND 5) AS n_out_of_range,
    count(*) FILTER (WHERE severity IS NULL) AS n_null,
    (SELECT coalesce(string_agg(CAST(l AS VARCHAR), ',' ORDER BY l), '') FROM (SELECT unnest(range(1, 6)) AS l)
      WHERE l NOT IN (SELECT severity FROM reports WHERE severity IS NOT NULL)) AS absent_levels,
    count(*) FILTER (WHERE severity IS NULL OR severity NOT BETWEEN 1 AND 5) = 0 AS rule_holds
    FROM reports""",
)
def check_range_rule(spark, sf):
    return check_range(reports(spark, sf), "severity", 1, 5)


@query(
    "check_binary_flags",
    f"WITH {REPORTS_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS flag, count(*) FILTER (WHERE {f} NOT IN (0, 1)) AS n_not_binary,
        count(*) FILTER (WHERE {f} IS NULL) AS n_null,
        count(*) FILTER (WHERE {f} IS NULL OR {f} NOT IN (0, 1)) = 0 AS binary,
        count(*) FILTER (WHERE type_heat + type_pressure + type_noise = 0) AS n_rows_without_signal FROM reports"""
        for f in REPORT_FLAGS
    ),
)
def check_binary_flags_query(spark, sf):
    return check_binary_flags(reports(spark, sf), REPORT_FLAGS)


@query(
    "check_flag_values",
    f"WITH {REPORTS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, {f} AS value, count(*) AS n FROM reports WHERE {f} NOT IN (0, 1) GROUP BY 2"
        for f in REPORT_FLAGS
    ),
)
def check_flag_values(spark, sf):
    return bad_flag_values(reports(spark, sf), REPORT_FLAGS)


@query(
    "check_shift",
    f"""WITH {REPORTS_SQL},
    o AS (SELECT CAST(substr(time, 1, 2) AS INTEGER) AS h, shift, count(*) AS n FROM reports
      WHERE CAST(substr(time, 1, 2) AS INTEGER) < 24 GROUP BY ALL),
    m AS (SELECT *, first_value(shift) OVER (PARTITION BY h ORDER BY n DESC, shift) AS modal FROM o),
    p AS (SELECT shift, count(*) AS hours FROM m GROUP BY shift),
    s AS (SELECT count(*) AS n_shifts, min(hours) AS min_hours, max(hours) AS max_hours FROM p)
    SELECT n_shifts, min_hours, max_hours,
      CAST((SELECT count(DISTINCT h) FROM m) AS INTEGER) AS n_hours_covered,
      (SELECT CAST(coalesce(sum(n) FILTER (WHERE shift <> modal), 0) AS BIGINT) FROM m) AS n_mismatched,
      n_shifts = 3 AND min_hours = 8 AND max_hours = 8 AND (SELECT count(DISTINCT h) FROM m) = 24 AS partition_3x8
    FROM s""",
)
def check_shift(spark, sf):
    return check_shifts(reports(spark, sf))


@query(
    "determinism_check",
    f"""WITH {REPORTS_SQL},
    t AS (SELECT comment, count(DISTINCT type_noise) AS k, count(*) AS n FROM reports GROUP BY comment)
    SELECT count(*) FILTER (WHERE comment IS NOT NULL) AS n_distinct,
      CAST(coalesce(sum(n) FILTER (WHERE comment IS NULL), 0) AS BIGINT) AS n_null,
      count(*) FILTER (WHERE comment IS NOT NULL AND k > 1) AS n_ambiguous,
      coalesce(max(k) FILTER (WHERE comment IS NOT NULL), 0) AS max_results FROM t""",
)
def determinism_check(spark, sf):
    return stats.determinism(reports(spark, sf), "comment", "type_noise")


@query(
    "enrich_time",
    """SELECT event_id, CAST(ts AS DATE) AS jour, CAST(hour(ts) AS INTEGER) AS heure, dayname(ts) AS weekday,
    CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'matin' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'apres-midi'
      ELSE 'nuit' END AS shift FROM events""",
)
def enrich_time(spark, sf):
    ev = read_table(spark, sf, "events")
    return enrich_telemetry(ev, "ts").select("event_id", "jour", "heure", "weekday", "shift")


@query(
    "conform_ts",
    """SELECT event_id, ts AS naive, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS midnight, epoch_us(ts) AS us,
    printf('%04d-S%02d', isoyear(ts), week(ts)) AS semaine_iso FROM events""",
)
def conform_ts(spark, sf):
    ev = read_table(spark, sf, "events")
    zoned = F.col("ts").cast("timestamp")
    return ev.select(
        "event_id",
        naive_utc(zoned).alias("naive"),
        naive_utc(F.to_date("ts")).alias("midnight"),
        micros(zoned).alias("us"),
        iso_week(F.col("ts")).alias("semaine_iso"),
    )

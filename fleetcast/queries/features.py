"""Queries over rolling features, cleaning, splits and the feature matrix."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fleetcast.functions.time import cyclic
from fleetcast.operators.quality import interpolate
from fleetcast.operators.rolling import (
    apply_trailing,
    hours_in_segment as add_hours_in_segment,
    lag_features,
    production_stats,
    production_total,
    quality_stats,
    rolling_stats as stats_of,
    segment_frame,
)
from fleetcast.operators.splits import (
    assign_split,
    fold_bounds,
    fold_smd as fold_report,
    split_label_rates as label_rates,
    split_shares as shares_by_split,
    split_smd as smd_by_split,
)
from fleetcast.operators.timeline import context_chunks, label_columns
from fleetcast.plans.gold import feature_matrix, matrix_metrics, static_columns
from fleetcast.plans.silver import clean_metrics as metrics_of_clean, clean_telemetry
from fleetcast.queries.base import (
    LOG,
    LOG_SQL,
    SEGMENT_SQL,
    log_incidents,
    log_maintenance,
    log_readings,
    query,
    rounded,
)
from fleetcast.queries.timelines import context
from fleetcast.session import stage
from fleetcast.sources.tables import read_table

HOURS = LOG.windows_h
SENSORS = LOG.sensors
LOG_WIDTH = {"s2": 0.5}


def log_chunks(spark, sf, *payload):
    return context_chunks(context(spark, sf, *payload, keep_chunks=True), LOG)


def operational(spark, sf, *payload):
    return log_chunks(spark, sf, *payload).filter("NOT during_maintenance")


def assets(spark, sf):
    """Machine attributes of the log entities, from customer, nation and region."""
    c, n, r = (read_table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("machine_code"),
        F.col("n_name").alias("model"),
        F.col("c_mktsegment").alias("criticality"),
        F.concat(F.lit("LINE-"), F.col("n_regionkey").cast("string")).alias("production_line"),
        F.col("r_name").alias("location"),
        (F.lit(100) + F.col("c_nationkey")).alias("max_hourly_capacity_pieces"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey") * 30).alias(
            "commissioning_date"
        ),
    )


ASSETS_SQL = """
assets AS (
  SELECT c_custkey AS user_id, c_name AS machine_code, n_name AS model,
    c_mktsegment AS criticality, 'LINE-' || n_regionkey AS production_line, r_name AS location,
    100 + c_nationkey AS max_hourly_capacity_pieces,
    CAST(DATE '2020-01-01' + c_nationkey * 30 AS DATE) AS commissioning_date
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
"""

OPS_SQL = SEGMENT_SQL + """,
ops AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id, segment)) / 3600000000.0 AS x
  FROM located WHERE NOT during_maintenance)
"""


def windows_sql() -> str:
    frames = [
        f"w{h} AS (PARTITION BY user_id, segment ORDER BY us RANGE BETWEEN "
        f"{h * 3600000000 - 1} PRECEDING AND CURRENT ROW)"
        for h in HOURS
    ]
    return "WINDOW " + ", ".join(frames)


def stat_sql(s: str, stat: str, h: int) -> str:
    w = f"OVER w{h}"
    body = {
        "mean": f"avg({s}) {w}",
        "std": f"stddev_samp({s}) {w}",
        "min": f"min({s}) {w}",
        "max": f"max({s}) {w}",
        "slope": f"CASE WHEN count({s}) {w} = 1 THEN 0.0 WHEN count({s}) {w} > 1 THEN regr_slope({s}, x) {w} END",
    }[stat]
    return f"{body} AS {s}_{stat}_{h}h"


def rounded_sql(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


BASIC = ("mean", "std", "min", "max")
BASIC_COLS = [f"{s}_{st}_{h}h" for h in HOURS for s in SENSORS for st in BASIC]
SLOPE_COLS = [f"{s}_slope_{h}h" for h in HOURS for s in SENSORS]


@query(
    "rolling_stats",
    f"WITH {OPS_SQL}, f AS (SELECT event_id, "
    + ", ".join(stat_sql(s, st, h) for h in HOURS for s in SENSORS for st in BASIC)
    + f" FROM ops {windows_sql()}) SELECT event_id, {rounded_sql(BASIC_COLS)} FROM f",
)
def rolling_stats(spark, sf):
    frame = segment_frame(operational(spark, sf, "s1", "s2"), LOG)
    out = apply_trailing(frame, LOG, stats_of(LOG, BASIC))
    return rounded(out.select("event_id", *BASIC_COLS), *BASIC_COLS)


@query(
    "rolling_slope",
    f"WITH {OPS_SQL}, f AS (SELECT event_id, "
    + ", ".join(stat_sql(s, "slope", h) for h in HOURS for s in SENSORS)
    + f" FROM ops {windows_sql()}) SELECT event_id, {rounded_sql(SLOPE_COLS)} FROM f",
)
def rolling_slope(spark, sf):
    frame = segment_frame(operational(spark, sf, "s1", "s2"), LOG)
    out = apply_trailing(frame, LOG, stats_of(LOG, ("slope",)))
    return rounded(out.select("event_id", *SLOPE_COLS), *SLOPE_COLS)


@query(
    "production",
    f"""WITH {OPS_SQL}, {ASSETS_SQL}, f AS (
    SELECT event_id, user_id, pieces,
      CAST(sum(pieces) OVER w24 AS BIGINT) AS prod_sum_24h, avg(pieces) OVER w24 AS prod_mean_24h,
      CAST(sum(pieces) OVER (PARTITION BY user_id, segment ORDER BY us
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prod_cumul_segment
    FROM ops {windows_sql()})
    SELECT event_id, prod_sum_24h, round(prod_mean_24h, 6) AS prod_mean_24h, prod_cumul_segment,
      round(pieces / CAST(max_hourly_capacity_pieces AS DOUBLE), 6) AS utilisation
    FROM f LEFT JOIN assets USING (user_id)""",
)
def production(spark, sf):
    frame = segment_frame(operational(spark, sf, "pieces"), LOG)
    out = apply_trailing(
        frame, LOG, production_stats(LOG), {"prod_cumul_segment": production_total(LOG)}
    )
    out = out.join(assets(spark, sf), "user_id", "left").withColumn(
        "utilisation",
        F.try_divide(F.col("pieces").cast("double"), F.col("max_hourly_capacity_pieces")),
    )
    out = out.select("event_id", "prod_sum_24h", "prod_mean_24h", "prod_cumul_segment", "utilisation")
    return rounded(out, "prod_mean_24h", "utilisation")


@query(
    "production_fraction",
    f"""WITH {OPS_SQL}, f AS (
    SELECT event_id, s1, sum(s1) OVER w24 AS a, avg(s1) OVER w24 AS b,
      sum(s1) OVER (PARTITION BY user_id, segment ORDER BY us ROWS UNBOUNDED PRECEDING) AS c FROM ops {windows_sql()})
    SELECT event_id, round(a, 6) AS prod_sum_24h, round(b, 6) AS prod_mean_24h,
      round(CASE WHEN s1 IS NOT NULL THEN c END, 6) AS prod_cumul_segment FROM f""",
)
def production_fraction(spark, sf):
    """Production measured in fractions: a sensor stands for it."""
    roles = replace(LOG, production="s1")
    frame = segment_frame(operational(spark, sf, "s1"), roles)
    out = apply_trailing(frame, roles, production_stats(roles), {"prod_cumul_segment": production_total(roles)})
    cols = ["prod_sum_24h", "prod_mean_24h", "prod_cumul_segment"]
    return rounded(out.select("event_id", *cols), *cols)


@query(
    "hours_in_segment",
    f"WITH {OPS_SQL} SELECT event_id, round(x, 6) AS hours_in_segment FROM ops",
)
def hours_in_segment(spark, sf):
    frame = segment_frame(operational(spark, sf), LOG)
    out = add_hours_in_segment(frame, LOG).select("event_id", "hours_in_segment")
    return rounded(out, "hours_in_segment")


@query(
    "lags",
    f"WITH {OPS_SQL} SELECT event_id, "
    + ", ".join(f"lag({s}, {k}) OVER w AS {s}_lag_{k}" for s in SENSORS for k in (1, 3, 6))
    + " FROM ops WINDOW w AS (PARTITION BY user_id, segment ORDER BY us)",
)
def lags(spark, sf):
    out = lag_features(operational(spark, sf, "s1", "s2"), LOG)
    return out.select("event_id", *[f"{s}_lag_{k}" for s in SENSORS for k in (1, 3, 6)])


# --- cleaning ------------------------------------------------------------------------------


def _filled_sql() -> str:
    """Positional interpolation inside (entity, segment) on operational rows, both edges filled."""
    pos = ", ".join(
        f"max(CASE WHEN {s} IS NOT NULL THEN pos END) OVER (PARTITION BY user_id, segment "
        f"ORDER BY pos ROWS UNBOUNDED PRECEDING) AS pp_{s}, "
        f"min(CASE WHEN {s} IS NOT NULL THEN pos END) OVER (PARTITION BY user_id, segment "
        f"ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np_{s}"
        for s in SENSORS
    )
    joins = " ".join(
        f"LEFT JOIN known p_{s} ON p_{s}.user_id = k.user_id AND p_{s}.segment = k.segment "
        f"AND p_{s}.pos = k.pp_{s} LEFT JOIN known n_{s} ON n_{s}.user_id = k.user_id "
        f"AND n_{s}.segment = k.segment AND n_{s}.pos = k.np_{s}"
        for s in SENSORS
    )
    value = {
        s: f"CASE WHEN k.{s} IS NOT NULL THEN k.{s} WHEN p_{s}.{s} IS NOT NULL AND n_{s}.{s} "
        f"IS NOT NULL THEN p_{s}.{s} + (n_{s}.{s} - p_{s}.{s}) * ((k.pos - k.pp_{s}) / "
        f"CAST(k.np_{s} - k.pp_{s} AS DOUBLE)) ELSE coalesce(p_{s}.{s}, n_{s}.{s}) END"
        for s in SENSORS
    }
    filled = ", ".join(
        f"{value[s]} AS {s}, (k.{s} IS NULL AND {value[s]} IS NOT NULL) AS {s}_was_imputed"
        for s in SENSORS
    )
    plain = ", ".join(f"{s}, false" for s in SENSORS)
    base = "event_id, user_id, us, ts, pieces, segment, during_maintenance"
    return (
        SEGMENT_SQL
        + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY us) AS pos
  FROM located WHERE NOT during_maintenance),
known AS (SELECT *, {pos} FROM numbered),
filled AS (
  SELECT {", ".join("k." + c for c in base.split(", "))}, {filled} FROM known k {joins}
  UNION ALL SELECT {base}, {plain} FROM located WHERE during_maintenance)
"""
    )


FILLED_SQL = _filled_sql()

CLEAN_SQL = (
    FILLED_SQL
    + """,
bounds AS (SELECT """
    + ", ".join(
        f"quantile_cont({s}, 0.25) - 1.5 * (quantile_cont({s}, 0.75) - quantile_cont({s}, 0.25)) "
        f"AS lo_{s}, quantile_cont({s}, 0.75) + 1.5 * (quantile_cont({s}, 0.75) - "
        f"quantile_cont({s}, 0.25)) AS hi_{s}, min({s}) AS min_{s}, max({s}) AS max_{s}"
        for s in SENSORS
    )
    + """ FROM filled),
hits AS (SELECT """
    + ", ".join(
        f"count(*) FILTER (WHERE {s} = max_{s}) AS at_hi_{s}, "
        f"count(*) FILTER (WHERE {s} = min_{s}) AS at_lo_{s}, "
        f"count(*) FILTER (WHERE {s} >= max_{s} - {LOG_WIDTH.get(s, 1.0)} AND {s} < max_{s}) AS by_hi_{s}, "
        f"count(*) FILTER (WHERE {s} > min_{s} AND {s} <= min_{s} + {LOG_WIDTH.get(s, 1.0)}) AS by_lo_{s}"
        for s in SENSORS
    )
    + """ FROM filled, bounds),
clean AS (SELECT filled.*, """
    + ", ".join(
        f"coalesce({s} < lo_{s} OR {s} > hi_{s}, false) AS {s}_is_outlier, "
        f"coalesce(({s} = max_{s} AND max_{s} > min_{s} AND at_hi_{s} >= 3 AND at_hi_{s} > 2.0 * "
        f"greatest(by_hi_{s}, 1)) OR ({s} = min_{s} AND max_{s} > min_{s} AND at_lo_{s} >= 3 AND "
        f"at_lo_{s} > 2.0 * greatest(by_lo_{s}, 1)), false) AS {s}_is_saturated"
        for s in SENSORS
    )
    + """ FROM filled, bounds, hits)
"""
)


@query(
    "interpolate",
    f"WITH {FILLED_SQL} SELECT event_id, during_maintenance, "
    + ", ".join(f"round({s}, 6) AS {s}, {s}_was_imputed" for s in SENSORS)
    + " FROM filled",
)
def interpolate_query(spark, sf):
    out = interpolate(log_chunks(spark, sf, "s1", "s2"), LOG)
    marks = [f"{s}_was_imputed" for s in SENSORS]
    return rounded(out.select("event_id", "during_maintenance", *SENSORS, *marks), *SENSORS)


def clean_log(spark, sf, *payload):
    return clean_telemetry(
        log_readings(spark, sf).select("event_id", "user_id", "us", *SENSORS, *payload),
        log_incidents(spark, sf).select("user_id", "us"),
        log_maintenance(spark, sf),
        LOG,
        LOG_WIDTH,
    )


@query(
    "clean_metrics",
    f"WITH {CLEAN_SQL} SELECT count(*) AS n_rows, "
    "count(*) FILTER (WHERE during_maintenance) AS n_during_maintenance, "
    + ", ".join(
        f"count(*) FILTER (WHERE {s}_was_imputed) AS n_imputed_{s}, "
        f"count(*) FILTER (WHERE {s}_is_outlier) AS n_outlier_{s}, "
        f"count(*) FILTER (WHERE {s}_is_saturated) AS n_saturated_{s}, "
        f"count(*) FILTER (WHERE {s} IS NULL) AS n_null_{s}"
        for s in SENSORS
    )
    + ", (SELECT count(*) - count(DISTINCT (user_id, us)) FROM readings) AS n_duplicates_removed FROM clean",
)
def clean_metrics(spark, sf):
    # one number: readings beyond the first of their key
    repeated = log_readings(spark, sf).groupBy("user_id", "us").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return metrics_of_clean(clean_log(spark, sf), LOG, repeated)


_QUALITY = [f"n_{m}_{h}h" for m in ("imputed", "outlier", "saturated") for h in HOURS]


def quality_sql() -> str:
    marks = {"imputed": "was_imputed", "outlier": "is_outlier", "saturated": "is_saturated"}
    return ", ".join(
        f"CAST(sum({' + '.join(f'CAST({s}_{mark} AS INTEGER)' for s in SENSORS)}) OVER w{h} "
        f"AS BIGINT) AS n_{name}_{h}h"
        for name, mark in marks.items()
        for h in HOURS
    )


@query(
    "quality_counts",
    f"WITH {CLEAN_SQL} SELECT event_id, {quality_sql()} FROM clean "
    f"WHERE NOT during_maintenance {windows_sql()}",
)
def quality_counts(spark, sf):
    ops = clean_log(spark, sf).filter("NOT during_maintenance")
    frame = segment_frame(ops, LOG)
    return apply_trailing(frame, LOG, quality_stats(LOG)).select("event_id", *_QUALITY)


# --- static and cyclic -------------------------------------------------------------------

_CYC = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]

CYCLIC_SQL = """sin(2 * pi() * hour(ts) / 24) AS hour_sin, cos(2 * pi() * hour(ts) / 24) AS hour_cos,
sin(2 * pi() * (isodow(ts) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) AS dow_cos"""
SHIFT_SQL = """CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'matin'
WHEN hour(ts) BETWEEN 14 AND 21 THEN 'apres-midi' ELSE 'nuit' END AS shift"""


@query(
    "cyclical",
    f"WITH f AS (SELECT event_id, {CYCLIC_SQL} FROM events) "
    f"SELECT event_id, {rounded_sql(_CYC)} FROM f",
)
def cyclical(spark, sf):
    ev = read_table(spark, sf, "events")
    return rounded(ev.select("event_id", *[c.alias(n) for n, c in cyclic("ts").items()]), *_CYC)


@query(
    "static_attrs",
    f"""WITH {ASSETS_SQL}
    SELECT event_id, machine_code, model, criticality, production_line, location,
      max_hourly_capacity_pieces, date_diff('day', commissioning_date, CAST(ts AS DATE)) AS age_days,
      {SHIFT_SQL}
    FROM events LEFT JOIN assets USING (user_id)""",
)
def static_attrs(spark, sf):
    ev = read_table(spark, sf, "events")
    made = static_columns("ts")
    return ev.join(assets(spark, sf), "user_id", "left").select(
        "event_id",
        "machine_code",
        "model",
        "criticality",
        "production_line",
        "location",
        "max_hourly_capacity_pieces",
        made["age_days"].alias("age_days"),
        made["shift"].alias("shift"),
    )


# --- the matrix and its splits ---------------------------------------------------------------

_ROLL = [f"{s}_{st}_{h}h" for h in HOURS for s in SENSORS for st in (*BASIC, "slope")]
_HIST = ["n_incidents_7d", "n_incidents_30d", "n_maintenance_30d"]
_SINCE = ["time_since_last_maintenance_h", "time_since_last_incident_h"]
_LABELS = [f"label_incident_{h}h" for h in LOG.horizons_h]
_ATTR = ["machine_code", "model", "criticality", "production_line", "location", "max_hourly_capacity_pieces"]


def matrix(spark, sf):
    return feature_matrix(
        clean_log(spark, sf, "ts", "pieces"),
        None,
        None,
        assets(spark, sf),
        LOG,
        ts="ts",
        has_context=True,
    )


MATRIX_SQL = (
    CLEAN_SQL
    + ","
    + ASSETS_SQL
    + """,
cops AS (SELECT *, (us - min(us) OVER (PARTITION BY user_id, segment)) / 3600000000.0 AS x
  FROM clean WHERE NOT during_maintenance),
feat AS (SELECT event_id, user_id, us, ts, pieces, s1, s2, """
    + ", ".join(stat_sql(s, st, h) for h in HOURS for s in SENSORS for st in (*BASIC, "slope"))
    + ", "
    + quality_sql()
    + """, CAST(sum(pieces) OVER w24 AS BIGINT) AS prod_sum_24h, avg(pieces) OVER w24 AS prod_mean_24h,
  CAST(sum(pieces) OVER (PARTITION BY user_id, segment ORDER BY us ROWS UNBOUNDED PRECEDING)
    AS BIGINT) AS prod_cumul_segment
  FROM cops """
    + windows_sql()
    + """),
prevs AS (SELECT f.event_id, m.end_us FROM feat f
  ASOF LEFT JOIN maintenance m ON f.user_id = m.user_id AND f.us >= m.us),
lasts AS (SELECT f.event_id, i.us AS inc_us FROM feat f
  ASOF LEFT JOIN incidents i ON f.user_id = i.user_id AND f.us > i.us),
nexts AS (SELECT f.event_id, i.us AS next_us FROM feat f
  ASOF LEFT JOIN incidents i ON f.user_id = i.user_id AND f.us < i.us),
span AS (SELECT min(us) AS lo, max(us) AS hi FROM feat),
matrix AS (
  SELECT f.* EXCLUDE (us), """
    + ", ".join(_ATTR)
    + f""", {CYCLIC_SQL}, {SHIFT_SQL},
    date_diff('day', commissioning_date, CAST(ts AS DATE)) AS age_days,
    pieces / CAST(max_hourly_capacity_pieces AS DOUBLE) AS utilisation,
    CASE WHEN end_us IS NULL THEN NULL ELSE greatest(us - end_us, 0) / 3600000000.0 END
      AS time_since_last_maintenance_h,
    (us - inc_us) / 3600000000.0 AS time_since_last_incident_h,
    (SELECT count(*) FROM incidents i WHERE i.user_id = f.user_id
      AND i.us < f.us AND i.us >= f.us - 604800000000) AS n_incidents_7d,
    (SELECT count(*) FROM incidents i WHERE i.user_id = f.user_id
      AND i.us < f.us AND i.us >= f.us - 2592000000000) AS n_incidents_30d,
    (SELECT count(*) FROM maintenance m WHERE m.user_id = f.user_id
      AND m.us < f.us AND m.us >= f.us - 2592000000000) AS n_maintenance_30d,
    (next_us - us) / 3600000000.0 AS rul_hours, CAST(next_us IS NULL AS INTEGER) AS rul_censored,
    """
    + ", ".join(
        f"CAST(coalesce(next_us - us <= {h} * 3600000000, false) AS INTEGER) AS label_incident_{h}h"
        for h in LOG.horizons_h
    )
    + """,
    CASE WHEN us < lo + (hi - lo) * 0.70 THEN 'train'
         WHEN us < lo + (hi - lo) * 0.85 THEN 'val' ELSE 'test' END AS split
  FROM feat f JOIN prevs USING (event_id) JOIN lasts USING (event_id) JOIN nexts USING (event_id)
  LEFT JOIN assets USING (user_id) CROSS JOIN span)
"""
)

_MATRIX_ROUND = ["s1", "s2", *[c for c in _ROLL if "slope" not in c], "prod_mean_24h", "utilisation",
                 *_SINCE, "rul_hours", *_CYC]
_MATRIX_SLOPES = [c for c in _ROLL if "slope" in c]
_MATRIX_PLAIN = ["event_id", "user_id", "ts", "pieces", *_QUALITY, "prod_sum_24h", "prod_cumul_segment",
                 *_ATTR, "shift", "age_days", *_HIST, "rul_censored", *_LABELS, "split"]


@query(
    "gold_matrix",
    f"WITH {MATRIX_SQL} SELECT {', '.join(_MATRIX_PLAIN)}, {rounded_sql(_MATRIX_ROUND)}, "
    f"{rounded_sql(_MATRIX_SLOPES)} FROM matrix",
)
def gold_matrix(spark, sf):
    out = matrix(spark, sf).select(*_MATRIX_PLAIN, *_MATRIX_ROUND, *_MATRIX_SLOPES)
    return rounded(out, *_MATRIX_ROUND, *_MATRIX_SLOPES)


@query(
    "gold_metrics",
    f"WITH {MATRIX_SQL} SELECT count(*) AS n_rows, {len(_MATRIX_PLAIN + _MATRIX_ROUND + _MATRIX_SLOPES)} "
    f"AS n_columns, {len(_MATRIX_PLAIN + _MATRIX_ROUND + _MATRIX_SLOPES) - 9} AS n_features, "
    + ", ".join(f"round(avg(label_incident_{h}h), 4) AS rate_{h}h" for h in LOG.horizons_h)
    + ", CAST(sum(rul_censored) AS BIGINT) AS n_censored, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS n_{s}" for s in ("train", "val", "test"))
    + " FROM matrix",
)
def gold_metrics(spark, sf):
    return matrix_metrics(matrix(spark, sf), LOG.horizons_h)


SPAN_SQL = """span AS (SELECT min(us) AS lo, max(us) AS hi FROM readings),
parted AS (SELECT readings.*, CASE WHEN us < lo + (hi - lo) * 0.70 THEN 'train'
  WHEN us < lo + (hi - lo) * 0.85 THEN 'val' ELSE 'test' END AS split FROM readings, span)"""


@query("chrono_split", f"WITH {LOG_SQL}, {SPAN_SQL} SELECT event_id, split FROM parted")
def chrono_split(spark, sf):
    return assign_split(log_readings(spark, sf), "us").select("event_id", "split")


@query(
    "split_label_rates",
    f"WITH {LOG_SQL}, {SPAN_SQL}, nexts AS (SELECT p.split, p.us, i.us AS next_us FROM parted p "
    "ASOF LEFT JOIN incidents i ON p.user_id = i.user_id AND p.us < i.us), l AS (SELECT split, h, "
    "CASE WHEN next_us - us <= h * 3600000000 THEN 1 ELSE 0 END AS y FROM nexts, "
    "(SELECT unnest([6, 12, 24, 48]) AS h)) SELECT CAST(h AS INTEGER) AS horizon_h, "
    + ", ".join(f"round(avg(y) FILTER (WHERE split = '{s}'), 4) AS {s}" for s in ("train", "val", "test"))
    + " FROM l GROUP BY h",
)
def split_label_rates(spark, sf):
    labelled = stage(context(spark, sf).withColumns(label_columns(LOG.horizons_h)))
    return label_rates(assign_split(labelled, "us"), LOG.horizons_h)


@query(
    "split_smd",
    f"WITH {LOG_SQL}, {SPAN_SQL}, l AS (UNPIVOT (SELECT split, s1, s2, CAST(pieces AS DOUBLE) AS pieces "
    "FROM parted) ON s1, s2, pieces INTO NAME feature VALUE v), a AS (SELECT feature, "
    "avg(v) FILTER (WHERE split = 'train') AS a, avg(v) FILTER (WHERE split = 'val') AS b, "
    "avg(v) FILTER (WHERE split = 'test') AS c, var_samp(v) FILTER (WHERE split = 'train') AS va, "
    "var_samp(v) FILTER (WHERE split = 'test') AS vc FROM l GROUP BY feature) "
    "SELECT feature, round(a, 4) AS train_mean, round(b, 4) AS val_mean, round(c, 4) AS test_mean, "
    "round(CASE WHEN sqrt((va + vc) / 2) > 0 THEN (c - a) / sqrt((va + vc) / 2) ELSE 0 END, 4) "
    "AS smd_train_test FROM a",
)
def split_smd(spark, sf):
    return smd_by_split(assign_split(log_readings(spark, sf), "us"), ["s1", "s2", "pieces"])


@query(
    "split_shares",
    f"WITH {LOG_SQL}, {SPAN_SQL}, {ASSETS_SQL}, j AS (SELECT split, model, criticality FROM parted "
    "JOIN assets USING (user_id)), l AS (UNPIVOT j ON model, criticality INTO NAME feature VALUE level), "
    "c AS (SELECT feature, level, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS {s}" for s in ("train", "val", "test"))
    + " FROM l GROUP BY feature, level) SELECT feature, level, "
    + ", ".join(f"round({s} / sum({s}) OVER (PARTITION BY feature), 4) AS {s}" for s in ("train", "val", "test"))
    + " FROM c",
)
def split_shares(spark, sf):
    parted = assign_split(log_readings(spark, sf), "us")
    joined = parted.join(assets(spark, sf), "user_id")
    return shares_by_split(joined, ["model", "criticality"])


_K = 5
FOLDS_SQL = f"""
ordered AS (SELECT r.*, row_number() OVER (ORDER BY us, event_id) - 1 AS i,
  count(*) OVER () AS n FROM readings r),
folds AS (SELECT f, n - ({_K} - f) * (n // ({_K} + 1)) AS start_i,
  n - ({_K} - f) * (n // ({_K} + 1)) + n // ({_K} + 1) AS end_i
  FROM (SELECT unnest(range({_K})) AS f), (SELECT count(*) AS n FROM readings)),
parts AS (SELECT o.*, CAST(f AS INTEGER) AS fold, CASE WHEN i < start_i THEN 'train' ELSE 'val' END
  AS role FROM ordered o JOIN folds ON i < end_i)
"""


@query(
    "ts_folds",
    f"""WITH {LOG_SQL}, {FOLDS_SQL}
    SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train,
      count(*) FILTER (WHERE role = 'val') AS n_val,
      max(us) FILTER (WHERE role = 'train') AS train_max_us,
      min(us) FILTER (WHERE role = 'val') AS val_min_us,
      max(us) FILTER (WHERE role = 'val') AS val_max_us FROM parts GROUP BY fold""",
)
def ts_folds(spark, sf):
    return fold_bounds(log_readings(spark, sf).select("event_id", "us"), "us", ["event_id"], _K)


@query(
    "fold_smd",
    f"""WITH {LOG_SQL}, {FOLDS_SQL},
    y AS (SELECT *, CASE WHEN s1 > 100 THEN 1 ELSE 0 END AS label FROM parts),
    l AS (UNPIVOT (SELECT fold, role, s1, s2 FROM y) ON s1, s2 INTO NAME feature VALUE v),
    a AS (SELECT fold, feature, avg(v) FILTER (WHERE role = 'train') AS ma,
      avg(v) FILTER (WHERE role = 'val') AS mb, var_pop(v) FILTER (WHERE role = 'train') AS va,
      var_pop(v) FILTER (WHERE role = 'val') AS vb FROM l GROUP BY fold, feature),
    s AS (SELECT fold, feature, abs(CASE WHEN sqrt((va + vb) / 2) > 0
      THEN (mb - ma) / sqrt((va + vb) / 2) ELSE 0 END) AS smd FROM a),
    t AS (SELECT fold, round(max(smd), 4) AS smd_abs_max, arg_max(feature, smd) AS smd_max_feature,
      CAST(count(*) FILTER (WHERE smd >= 0.1) AS INTEGER) AS n_features_smd_notable
      FROM s GROUP BY fold),
    r AS (SELECT fold, count(*) FILTER (WHERE role = 'train') AS n_train,
      count(*) FILTER (WHERE role = 'val') AS n_val,
      avg(label) FILTER (WHERE role = 'train') AS ra, avg(label) FILTER (WHERE role = 'val') AS rb
      FROM y GROUP BY fold)
    SELECT fold, n_train, n_val, round(ra, 4) AS pos_rate_train, round(rb, 4) AS pos_rate_val,
      round(abs(rb - ra), 4) AS pos_rate_abs_diff, smd_abs_max, smd_max_feature,
      n_features_smd_notable FROM r JOIN t USING (fold)""",
)
def fold_smd(spark, sf):
    rows = log_readings(spark, sf).withColumn("label", (F.coalesce("s1", F.lit(0.0)) > 100).cast("int"))
    return fold_report(rows.select("event_id", "us", "s1", "s2", "label"), "us", ["event_id"], "label", ["s1", "s2"], _K)

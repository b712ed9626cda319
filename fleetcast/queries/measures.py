"""Statistics of multi-sensor telemetry and of the machine log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.functions.time import shift_of_hour
from fleetcast.operators import quality, stats
from fleetcast.operators.quality import dedup_first
from fleetcast.operators.reshape import repivot as repivot_long, sensor_measurements
from fleetcast.queries.base import (
    DEDUP_SQL,
    LINE_TIES,
    WIDE,
    log_readings,
    query,
    rounded,
    telemetry,
)
from fleetcast.queries.features import CLEAN_SQL, SENSORS, clean_log
from fleetcast.session import stage
from fleetcast.sources.tables import read_table

COLS = list(WIDE.sensors)
WIDTHS = {"l_discount": 0.005, "l_tax": 0.005}


def _unpivot(cols=COLS, extra="", table="lineitem"):
    picks = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"(UNPIVOT (SELECT {extra}{picks} FROM {table}) ON {', '.join(cols)} INTO NAME measure VALUE v)"


@query(
    "dedup_first",
    f"WITH {DEDUP_SQL} SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity FROM dedup",
)
def dedup_query(spark, sf):
    out = dedup_first(telemetry(spark, sf), ["l_suppkey", "l_shipdate"], LINE_TIES)
    return out.select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "describe",
    f"""SELECT measure, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
    min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q1,
    round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3
    FROM {_unpivot()} GROUP BY measure""",
)
def describe(spark, sf):
    out = stats.describe(telemetry(spark, sf), COLS)
    return rounded(out, "mean", "std", "q1", "median", "q3")


@query(
    "mean_by_entity",
    "SELECT l_suppkey, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in COLS) + " FROM lineitem GROUP BY l_suppkey",
)
def mean_by_entity(spark, sf):
    return rounded(stats.group_means(telemetry(spark, sf), ["l_suppkey"], COLS), *COLS)


_BOUND_SQL = f"""
q AS (SELECT measure, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
  FROM {_unpivot()} GROUP BY measure),
b AS (SELECT measure, q1 - K * (q3 - q1) AS low, q3 + K * (q3 - q1) AS high FROM q)
"""


def _iqr_sql(k: float) -> str:
    return f"""WITH {_BOUND_SQL.replace('K *', f'{k} *')},
    l AS (SELECT * FROM {_unpivot()} JOIN b USING (measure))
    SELECT measure, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high,
      count(*) FILTER (WHERE v < low OR v > high) AS n_outliers,
      round(100.0 * count(*) FILTER (WHERE v < low OR v > high) / (SELECT count(*) FROM lineitem), 6) AS pct
    FROM l GROUP BY measure"""


@query("iqr_outliers", _iqr_sql(0.75))
def iqr_outliers(spark, sf):
    # a tighter factor than 1.5 so that the bounded columns have outliers
    return rounded(quality.detect_outliers(telemetry(spark, sf), COLS, 0.75), "low", "high", "pct")


@query(
    "flag_outliers",
    f"""WITH {_BOUND_SQL.replace('K *', '0.75 *')},
    {", ".join(f"b_{c} AS (SELECT low AS lo_{c}, high AS hi_{c} FROM b WHERE measure = '{c}')" for c in COLS)}
    SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"({c} < lo_{c} OR {c} > hi_{c}) AS {c}_is_outlier" for c in COLS)}
    FROM lineitem, {", ".join(f"b_{c}" for c in COLS)}""",
)
def flag_outliers(spark, sf):
    out = quality.flag_outliers(telemetry(spark, sf), COLS, 0.75)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[f"{c}_is_outlier" for c in COLS])


_SAT_SQL = ", ".join(
    f"""e_{c} AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem),
s_{c} AS (SELECT CAST(any_value(lo) AS DOUBLE) AS low, CAST(any_value(hi) AS DOUBLE) AS high,
  any_value(lo < hi) AND count(*) FILTER (WHERE {c} = lo) >= 3 AND count(*) FILTER (WHERE {c} = lo) >
    2.0 * greatest(count(*) FILTER (WHERE {c} > lo AND {c} <= lo + {WIDTHS.get(c, 1.0)}), 1) AS sl,
  any_value(lo < hi) AND count(*) FILTER (WHERE {c} = hi) >= 3 AND count(*) FILTER (WHERE {c} = hi) >
    2.0 * greatest(count(*) FILTER (WHERE {c} >= hi - {WIDTHS.get(c, 1.0)} AND {c} < hi), 1) AS sh,
  count(*) FILTER (WHERE {c} = lo) AS nl, count(*) FILTER (WHERE {c} = hi) AS nh, count(*) AS n
  FROM lineitem, e_{c})"""
    for c in COLS
)


@query(
    "saturation",
    f"WITH {_SAT_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, low, sl AS saturated_low, high, sh AS saturated_high,
        CAST(CASE WHEN sl THEN nl ELSE 0 END + CASE WHEN sh THEN nh ELSE 0 END AS BIGINT) AS n_saturated,
        round(100.0 * (CASE WHEN sl THEN nl ELSE 0 END + CASE WHEN sh THEN nh ELSE 0 END) / n, 6) AS pct
        FROM s_{c}"""
        for c in COLS
    ),
)
def saturation(spark, sf):
    return rounded(quality.detect_saturation(telemetry(spark, sf), COLS, WIDTHS), "pct")


@query(
    "flag_saturation",
    f"WITH {_SAT_SQL} SELECT l_orderkey, l_linenumber, l_partkey, "
    + ", ".join(
        f"((s_{c}.sl AND lineitem.{c} = s_{c}.low) OR (s_{c}.sh AND lineitem.{c} = s_{c}.high)) AS {c}_is_saturated"
        for c in COLS
    )
    + " FROM lineitem, "
    + ", ".join(f"s_{c}" for c in COLS),
)
def flag_saturation(spark, sf):
    out = quality.flag_saturation(telemetry(spark, sf), COLS, WIDTHS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", *[f"{c}_is_saturated" for c in COLS])


@query(
    "unit_consistency",
    f"""WITH m AS (SELECT l_suppkey, measure, avg(v) AS m FROM {_unpivot(extra='l_suppkey, ')} GROUP BY ALL)
    SELECT measure, round(min(m), 6) AS min_mean, round(max(m), 6) AS max_mean,
      round(max(m) / min(m), 6) AS ratio, max(m) / min(m) > 1.1 AS unit_suspect
    FROM m GROUP BY measure""",
)
def unit_consistency(spark, sf):
    out = quality.unit_consistency(telemetry(spark, sf), "l_suppkey", COLS, 1.1)
    return rounded(out, "min_mean", "max_mean", "ratio")


_PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i + 1 :]]


@query(
    "corr_pearson",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS
    ),
)
def corr_pearson(spark, sf):
    return rounded(stats.pearson(telemetry(spark, sf), COLS), "r")


_LOG_COLS = ["s1", "s2", "pieces"]
_LOG_PAIRS = [("s1", "s2"), ("s1", "pieces"), ("s2", "pieces")]


@query(
    "corr_spearman",
    "WITH r AS (SELECT CASE WHEN value >= 5 THEN value END AS s1, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s2, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS pieces FROM events "
    "WHERE event_type IN ('view', 'click', 'purchase')) "
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 6) AS r FROM (
        SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
          rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
        FROM r WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
        for a, b in _LOG_PAIRS
    ),
)
def corr_spearman(spark, sf):
    return rounded(stats.spearman(log_readings(spark, sf), _LOG_COLS), "r")


_OUT_SQL = ", ".join(
    f"""o_{c} AS (SELECT count(*) AS k FROM dedup, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dedup)
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""
    for c in COLS
)


@query(
    "telemetry_metrics",
    f"""WITH {DEDUP_SQL}, {_OUT_SQL}, {_SAT_SQL.replace('FROM lineitem', 'FROM dedup')},
    u AS (SELECT measure, max(m) / min(m) AS ratio FROM (SELECT l_suppkey, measure, avg(v) AS m
      FROM {_unpivot(extra='l_suppkey, ', table='dedup')} GROUP BY ALL) GROUP BY measure),
    s AS ({" UNION ALL ".join(f"SELECT '{c}' AS measure, sl OR sh AS hit, CASE WHEN sl THEN nl ELSE 0 END + CASE WHEN sh THEN nh ELSE 0 END AS k FROM s_{c}" for c in COLS)})
    SELECT count(*) AS n_rows, 11 AS n_columns, count(DISTINCT l_suppkey) AS n_machines,
    CAST(0 AS BIGINT) AS n_null, (SELECT count(*) FROM lineitem) - count(*) AS n_duplicates_removed,
    min(l_shipdate) AS period_start, max(l_shipdate) AS period_end,
    {" + ".join(f"(SELECT k FROM o_{c})" for c in COLS)} AS n_outliers,
    (SELECT coalesce(string_agg(measure, ',' ORDER BY measure), '') FROM u WHERE ratio > 1.5) AS unit_suspects,
    (SELECT CAST(sum(k) AS BIGINT) FROM s) AS n_saturated,
    (SELECT coalesce(string_agg(measure, ',' ORDER BY measure), '') FROM s WHERE hit) AS saturated_sensors
    FROM dedup""",
)
def telemetry_metrics(spark, sf):
    raw = telemetry(spark, sf)
    kept = stage(dedup_first(raw, ["l_suppkey", "l_shipdate"], LINE_TIES))
    return quality.telemetry_metrics(kept, WIDE, "l_shipdate", raw.count() - kept.count(), WIDTHS)


@query(
    "pivot_means",
    "SELECT l_returnflag, avg(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O, "
    "avg(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F FROM lineitem GROUP BY 1",
)
def pivot_means(spark, sf):
    return stats.pivot_means(telemetry(spark, sf), ["l_returnflag"], "l_linestatus", ["O", "F"], "l_quantity")


@query(
    "daily_mean",
    "SELECT CAST(l_shipdate AS DATE) AS jour, "
    + ", ".join(f"round(avg({c}), 6) AS {c}" for c in COLS)
    + " FROM lineitem GROUP BY 1",
)
def daily_mean(spark, sf):
    return rounded(stats.daily_means(telemetry(spark, sf), "l_shipdate", COLS), *COLS)


@query(
    "profile_zscore",
    f"""WITH m AS (SELECT measure, heure, avg(v) AS m FROM (UNPIVOT (
      SELECT CAST(hour(ts) AS INTEGER) AS heure, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
      FROM events) ON value, k INTO NAME measure VALUE v) GROUP BY ALL)
    SELECT measure, heure, round((m - avg(m) OVER w) / stddev_pop(m) OVER w, 6) AS z
    FROM m WINDOW w AS (PARTITION BY measure)""",
)
def profile_zscore(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.hour("ts").alias("heure"), "value", F.expr("CAST(get_json_object(props, '$.k') AS DOUBLE)").alias("k")
    )
    return rounded(stats.profile_zscore(ev, "heure", ["value", "k"]), "z")


@query(
    "profile_by_shift",
    """WITH m AS (SELECT CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'matin' WHEN hour(ts) BETWEEN 14 AND 21
      THEN 'apres-midi' ELSE 'nuit' END AS shift, avg(value) AS m FROM events GROUP BY 1)
    SELECT 'value' AS measure, shift, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS z FROM m""",
)
def profile_by_shift(spark, sf):
    ev = read_table(spark, sf, "events").select(shift_of_hour(F.hour("ts")).alias("shift"), "value")
    return rounded(stats.profile_zscore(ev, "shift", ["value"]), "z")


@query(
    "histogram",
    f"""WITH e AS (SELECT measure, min(v) AS lo, max(v) AS hi FROM {_unpivot()} GROUP BY measure),
    l AS (SELECT measure, lo, (hi - lo) / 50 AS step, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin
      FROM {_unpivot()} JOIN e USING (measure))
    SELECT measure, bin, round(any_value(lo) + bin * any_value(step), 6) AS bin_start, count(*) AS n
    FROM l GROUP BY measure, bin""",
)
def histogram(spark, sf):
    return rounded(stats.histogram(telemetry(spark, sf), COLS), "bin_start")


@query(
    "boxplot_stats",
    f"""WITH l AS (SELECT * FROM {_unpivot(['l_quantity', 'l_extendedprice'], 'l_suppkey, ')}),
    q AS (SELECT measure, l_suppkey, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.75) AS q3 FROM l GROUP BY ALL)
    SELECT measure, l_suppkey, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3,
      min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
      max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1)) AS whisker_high
    FROM l JOIN q USING (measure, l_suppkey) GROUP BY measure, l_suppkey""",
)
def boxplot_stats(spark, sf):
    out = stats.boxplot(telemetry(spark, sf), "l_suppkey", ["l_quantity", "l_extendedprice"])
    return rounded(out, "q1", "median", "q3")


@query(
    "corr_with_label",
    "SELECT feature, round(r, 6) AS r FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, corr({c}, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem"
        for c in COLS
    )
    + ") ORDER BY abs(r) DESC, feature LIMIT 3",
)
def corr_with_label(spark, sf):
    df = telemetry(spark, sf).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return rounded(stats.corr_with_label(df, COLS, "y", 3), "r")


# --- long and wide measurements ------------------------------------------------------------
_IDS = {s: i for i, s in enumerate(SENSORS, 1)}


@query(
    "measurement_long",
    f"WITH {CLEAN_SQL} "
    + " UNION ALL ".join(
        f"""SELECT event_id, CAST({i} AS INTEGER) AS sensor_id, round({s}, 6) AS value,
        {s}_was_imputed AS was_imputed, {s}_is_outlier AS is_outlier, {s}_is_saturated AS is_saturated FROM clean"""
        for s, i in _IDS.items()
    ),
)
def measurement_long(spark, sf):
    return rounded(sensor_measurements(clean_log(spark, sf), _IDS, ["event_id"]), "value")


@query(
    "repivot",
    f"WITH {CLEAN_SQL} SELECT event_id, user_id, "
    + ", ".join(
        f"round({s}, 6) AS {s}, {s}_was_imputed, {s}_is_outlier, {s}_is_saturated" for s in SENSORS
    )
    + " FROM clean",
)
def repivot(spark, sf):
    clean = clean_log(spark, sf)
    header = log_readings(spark, sf).select("event_id", "user_id")
    long = sensor_measurements(clean, _IDS, ["event_id"])
    out = repivot_long(header, long, {i: s for s, i in _IDS.items()}, key="event_id")
    return rounded(out, *SENSORS)


@query(
    "impute_constant",
    """WITH r AS (SELECT event_id, ts, CASE WHEN value >= 5 THEN value END AS s1 FROM events)
    SELECT event_id, round(coalesce(s1, (SELECT quantile_cont(s1, 0.5) FROM r WHERE ts < TIMESTAMP '2024-01-20')), 6) AS s1
    FROM r""",
)
def impute_constant(spark, sf):
    df = read_table(spark, sf, "events").select(
        "event_id", "ts", F.when(F.col("value") >= 5, F.col("value")).alias("s1")
    )
    fit = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    out = quality.impute_constant(df, ["s1"], "median", fit)
    return rounded(out.select("event_id", "s1"), "s1")


@query(
    "impute_mean",
    """WITH r AS (SELECT event_id, CASE WHEN value >= 5 THEN value END AS s1 FROM events)
    SELECT event_id, round(coalesce(s1, (SELECT avg(s1) FROM r)), 6) AS s1 FROM r""",
)
def impute_mean(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("s1"))
    return rounded(quality.impute_constant(df, ["s1"], "mean"), "s1")

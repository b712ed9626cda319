"""Schema contracts, personal-data scan, feature roles, importance tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.operators.conform import column_roles, pii_scan as scan_names
from fleetcast.operators.contract import build_contract, column_types, compare_schemas
from fleetcast.operators.contract import load_contract, save_contract, schema_drift as drift
from fleetcast.operators.explain import compare_importance, importance_table as importance, linear_attributions
from fleetcast.operators.quality import fit_constants
from fleetcast.operators.stats import profile as profile_table
from fleetcast.queries.base import REPORTS_SQL, query, reports, rounded, telemetry
from fleetcast.session import scratch_dir
from fleetcast.sources.sinks import new_path
from fleetcast.sources.tables import read_table

_EVENT_TYPES = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
                "value": "double", "props": "string"}


@query(
    "profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(DISTINCT {c}) AS n_unique FROM events"
        for c, t in _EVENT_TYPES.items()
    ),
)
def profile(spark, sf):
    return profile_table(read_table(spark, sf, "events"))


def _changed(events):
    """The events table as a later delivery: one column gone, one new, one retyped."""
    return events.drop("props").withColumn("site", F.lit("x")).withColumn("value", F.col("value").cast("float"))


def _columns_sql(select: str) -> str:
    """(column, type) of a query from the catalog, in Spark's type names."""
    return f"""(SELECT column_name AS c, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
      WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'DATE' THEN 'date'
      ELSE lower(column_type) END AS t FROM (DESCRIBE {select}))"""


_CHANGED_SQL = "SELECT * EXCLUDE (props) REPLACE (CAST(value AS FLOAT) AS value), 'x' AS site FROM events"


@query(
    "schema_compare",
    f"""SELECT coalesce(o.c, n.c) AS "column", o.t AS old_type, n.t AS new_type,
    CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'retyped' END AS change
    FROM {_columns_sql("SELECT * FROM events")} o FULL JOIN {_columns_sql(_CHANGED_SQL)} n ON o.c = n.c WHERE o.t IS DISTINCT FROM n.t""",
)
def schema_compare(spark, sf):
    events = read_table(spark, sf, "events")
    return compare_schemas(column_types(events), column_types(_changed(events)))


def _sources_sql(**selects: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS s, c, t FROM {_columns_sql(select)}" for name, select in selects.items())


@query(
    "schema_drift",
    f"""WITH o AS ({_sources_sql(events="SELECT * FROM events", nation="SELECT * FROM nation")}),
    n AS ({_sources_sql(events=_CHANGED_SQL, region="SELECT * FROM region")})
    SELECT coalesce(o.s, n.s) AS source, coalesce(o.c, n.c) AS "column",
      CASE WHEN coalesce(o.s, n.s) NOT IN (SELECT s FROM o) THEN 'new_source' WHEN coalesce(o.s, n.s) NOT IN (SELECT s FROM n) THEN 'vanished_source'
        WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' ELSE 'retyped' END AS change, o.t AS old_type, n.t AS new_type
    FROM o FULL JOIN n ON o.s = n.s AND o.c = n.c WHERE o.t IS DISTINCT FROM n.t""",
)
def schema_drift(spark, sf):
    events, nation, region = (read_table(spark, sf, t) for t in ("events", "nation", "region"))
    path = new_path(scratch_dir(spark), "contract")
    save_contract(build_contract({"events": events, "nation": nation}, counts=True), path)
    return drift(load_contract(spark, path), build_contract({"events": _changed(events), "region": region}))


@query(
    "pii_scan",
    f"""SELECT c AS "column", regexp_matches(c, 'name|badge|operator') AS is_pii
    FROM {_columns_sql(f"(WITH {REPORTS_SQL} SELECT * FROM reports)")}""",
)
def pii_scan(spark, sf):
    return scan_names(reports(spark, sf))


@query(
    "ml_feature_select",
    f"""SELECT c AS feature, CASE WHEN t IN ('double', 'float', 'int', 'bigint') THEN 'numeric' ELSE 'categorical' END AS role
    FROM {_columns_sql("SELECT * FROM lineitem")} WHERE c NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_linestatus')
      AND (t IN ('double', 'float', 'int', 'bigint') OR c = 'l_returnflag')""",
)
def ml_feature_select(spark, sf):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    numeric, categorical = column_roles(telemetry(spark, sf), "l_linestatus", ids, ["l_returnflag", "l_linestatus"])
    rows = [(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical]
    return spark.createDataFrame(rows, "feature string, role string")


_WEIGHTS = {"l_quantity": 0.5, "l_extendedprice": -0.001, "l_discount": 20.0, "l_tax": -10.0}
_OTHER = {"l_quantity": 0.1, "l_extendedprice": -0.002, "l_discount": 40.0}


def _table(spark, sf, weights):
    df = telemetry(spark, sf)
    means = fit_constants(df, list(weights), "mean")
    return importance(linear_attributions(df, weights, means))


def _table_sql(weights, name):
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({w} * ({c} - m_{c}))) AS mean_abs FROM lineitem, means" for c, w in weights.items()
    )
    return f"""{name}0 AS ({parts}),
    {name} AS (SELECT feature, mean_abs, mean_abs / sum(mean_abs) OVER () AS share,
      row_number() OVER (ORDER BY mean_abs DESC, feature) AS rk FROM {name}0)"""


_MEANS_SQL = "means AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}" for c in _WEIGHTS) + " FROM lineitem)"


@query(
    "importance_table",
    f"WITH {_MEANS_SQL}, {_table_sql(_WEIGHTS, 't')} SELECT feature, round(mean_abs, 6) AS mean_abs, round(share, 6) AS importance_share FROM t",
)
def importance_table(spark, sf):
    return rounded(_table(spark, sf, _WEIGHTS), "mean_abs", "importance_share")


@query(
    "importance_compare",
    f"""WITH {_MEANS_SQL}, {_table_sql(_WEIGHTS, 'a')}, {_table_sql(_OTHER, 'b')},
    j AS (SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.mean_abs, 0) AS mean_abs_first, coalesce(b.mean_abs, 0) AS mean_abs_second,
      coalesce(a.share, 0) AS share_first, coalesce(b.share, 0) AS share_second, a.rk AS ra, b.rk AS rb
      FROM a FULL JOIN b ON a.feature = b.feature)
    SELECT feature, round(mean_abs_first, 6) AS mean_abs_first, round(mean_abs_second, 6) AS mean_abs_second,
      round(share_first, 6) AS share_first, round(share_second, 6) AS share_second,
      CAST(coalesce(ra, 5) AS INTEGER) AS rank_first, CAST(coalesce(rb, 5) AS INTEGER) AS rank_second,
      CAST(coalesce(ra, 5) - coalesce(rb, 5) AS INTEGER) AS delta_rank
    FROM j WHERE ra <= 3 OR rb <= 3""",
)
def importance_compare(spark, sf):
    out = compare_importance(_table(spark, sf, _WEIGHTS), _table(spark, sf, _OTHER), 3)
    return rounded(out, "mean_abs_first", "mean_abs_second", "share_first", "share_second")


@query(
    "linear_attribution",
    f"""WITH {_MEANS_SQL}, a AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {w} * ({c} - m_{c}) AS v FROM lineitem, means" for c, w in _WEIGHTS.items())})
    SELECT feature, count(*) AS n, round(min(v), 6) AS lowest, round(max(v), 6) AS highest FROM a GROUP BY feature""",
)
def linear_attribution(spark, sf):
    df = telemetry(spark, sf)
    means = fit_constants(df, list(_WEIGHTS), "mean")
    rows = linear_attributions(df, _WEIGHTS, means)
    out = rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("attribution").alias("lowest"), F.max("attribution").alias("highest")
    )
    return rounded(out, "lowest", "highest")

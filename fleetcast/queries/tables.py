"""Dimensions, keys, joins and counts of the machine register and the maintenance log."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.operators import checks, stats
from fleetcast.operators.conform import (
    capacity_columns,
    capacity_ratio_median,
    lookup_key,
    machine_dimension,
    number_rows,
    sensor_dimension,
    surrogate_dimension,
)
from fleetcast.operators.quality import dedup_first
from fleetcast.operators.reshape import month_counts
from fleetcast.queries.base import (
    DEDUP_SQL,
    INTERVENTIONS_SQL,
    LINE_TIES,
    MACHINES_SQL,
    interventions,
    machines,
    query,
    rounded,
    telemetry,
)
from fleetcast.roles import CRITICALITY_ORDER
from fleetcast.sources.tables import read_table


@query("dim_surrogate", f"WITH {MACHINES_SQL} SELECT row_number() OVER (ORDER BY model) AS model_id, model AS name FROM (SELECT DISTINCT model FROM machine)")
def dim_surrogate(spark, sf):
    return surrogate_dimension(machines(spark, sf), "model", "model_id")


@query(
    "dim_component",
    f"WITH {INTERVENTIONS_SQL} SELECT row_number() OVER (ORDER BY component) AS component_id, component AS name "
    "FROM (SELECT DISTINCT component FROM intervention)",
)
def dim_component(spark, sf):
    return surrogate_dimension(interventions(spark, sf), "component", "component_id")


@query(
    "dim_machine",
    f"""WITH {MACHINES_SQL},
    md AS (SELECT model, row_number() OVER (ORDER BY model) AS model_id FROM (SELECT DISTINCT model FROM machine)),
    r AS (SELECT *, max_daily_capacity / CAST(max_hourly_capacity_pieces AS DOUBLE) AS ratio FROM machine),
    q AS (SELECT quantile_cont(ratio, 0.5) AS mid FROM r)
    SELECT row_number() OVER (ORDER BY machine_code) AS machine_pk, machine_code, commissioning_date,
      max_daily_capacity, max_hourly_capacity_pieces, production_line, location, criticality,
      CAST(round_even(ratio, 0) AS INTEGER) AS heures_equivalentes_jour,
      abs(ratio - mid) > 1.0 AS capacite_incoherente, model_id
    FROM r JOIN md USING (model), q""",
)
def dim_machine(spark, sf):
    m = machines(spark, sf)
    return machine_dimension(m, surrogate_dimension(m, "model", "model_id"))


@query(
    "reading_header",
    f"WITH {DEDUP_SQL} SELECT row_number() OVER (ORDER BY l_suppkey, l_shipdate) AS reading_id, l_suppkey, l_shipdate, l_linenumber FROM dedup",
)
def reading_header(spark, sf):
    kept = dedup_first(telemetry(spark, sf), ["l_suppkey", "l_shipdate"], LINE_TIES)
    slim = kept.select("l_suppkey", "l_shipdate", "l_linenumber")
    return number_rows(slim, ["l_suppkey", "l_shipdate"], "reading_id")


@query(
    "fk_lookup",
    f"""WITH {MACHINES_SQL}, {INTERVENTIONS_SQL},
    d AS (SELECT machine_code, row_number() OVER (ORDER BY machine_code) AS machine_pk FROM machine)
    SELECT maintenance_id, machine_code, machine_pk FROM intervention LEFT JOIN d USING (machine_code)""",
)
def fk_lookup(spark, sf):
    dim = number_rows(machines(spark, sf).select("machine_code"), ["machine_code"], "machine_pk")
    facts = interventions(spark, sf).select("maintenance_id", "machine_code")
    return lookup_key(facts, dim.withColumnRenamed("machine_code", "code"), "machine_code", "code", "machine_pk")


@query(
    "star_join",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name, r_name, p_brand, o_orderpriority
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN part ON l_partkey = p_partkey""",
)
def star_join(spark, sf):
    t = {n: read_table(spark, sf, n) for n in ("lineitem", "orders", "supplier", "nation", "region", "part")}
    # dimension sizes decide the join kind at run time; nothing is hinted
    return (
        t["lineitem"]
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name", "r_name", "p_brand", "o_orderpriority")
    )


@query(
    "maint_by_month",
    f"""WITH {INTERVENTIONS_SQL} SELECT strftime(maintenance_at, '%Y-%m') AS month,
    count(*) FILTER (WHERE maintenance_type = 'proactive') AS proactive,
    count(*) FILTER (WHERE maintenance_type = 'reactive') AS reactive FROM intervention GROUP BY 1""",
)
def maint_by_month(spark, sf):
    return month_counts(interventions(spark, sf), "maintenance_at", "maintenance_type", ["proactive", "reactive"])


_ATTRIBUTES = ["model", "criticality", "production_line", "location"]


@query(
    "value_counts",
    f"WITH {MACHINES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS attribute, {e} AS level, count(*) AS n FROM machine GROUP BY 2"
        for a, e in [*[(a, a) for a in _ATTRIBUTES], ("year", "CAST(year(commissioning_date) AS VARCHAR)")]
    ),
)
def value_counts(spark, sf):
    cols = [*_ATTRIBUTES, F.year("commissioning_date")]
    counts = stats.value_counts(machines(spark, sf), cols, [*_ATTRIBUTES, "year"])
    return stats.in_order(counts, "level", CRITICALITY_ORDER)


@query(
    "mean_by_group",
    f"""WITH {MACHINES_SQL} SELECT model, round(avg(max_daily_capacity), 6) AS max_daily_capacity,
    round(avg(max_hourly_capacity_pieces), 6) AS max_hourly_capacity_pieces FROM machine GROUP BY model""",
)
def mean_by_group(spark, sf):
    cols = ["max_daily_capacity", "max_hourly_capacity_pieces"]
    means = stats.group_means(machines(spark, sf), ["model"], cols)
    return rounded(means.orderBy(F.desc(cols[0]), "model"), *cols)


@query(
    "maint_summary",
    f"""WITH {INTERVENTIONS_SQL} SELECT maintenance_type, count(*) AS count,
    round(avg(CAST(duration_hours AS DOUBLE)), 6) AS mean, CAST(min(duration_hours) AS DOUBLE) AS min,
    CAST(max(duration_hours) AS DOUBLE) AS max, count(related_incident_id) AS n_linked
    FROM intervention GROUP BY maintenance_type""",
)
def maint_summary(spark, sf):
    return rounded(checks.maintenance_summary(interventions(spark, sf)), "mean")


@query(
    "maint_by_component",
    f"WITH {INTERVENTIONS_SQL} SELECT component, count(*) AS count, count(related_incident_id) AS n_linked FROM intervention GROUP BY component",
)
def maint_by_component(spark, sf):
    return checks.maintenance_by_component(interventions(spark, sf))


@query(
    "maint_by_machine",
    f"""WITH {INTERVENTIONS_SQL} SELECT machine_code, count(*) FILTER (WHERE maintenance_type = 'proactive') AS proactive,
    count(*) FILTER (WHERE maintenance_type = 'reactive') AS reactive FROM intervention GROUP BY machine_code""",
)
def maint_by_machine(spark, sf):
    return checks.maintenance_by_machine(interventions(spark, sf), ["proactive", "reactive"])


@query(
    "topk",
    f"""WITH {INTERVENTIONS_SQL} SELECT machine_code, count(*) AS n FROM intervention GROUP BY machine_code
    ORDER BY n DESC, machine_code LIMIT 10""",
)
def topk(spark, sf):
    return stats.top_values(interventions(spark, sf), "machine_code", 10)


@query(
    "maint_metrics",
    f"""WITH {MACHINES_SQL}, {INTERVENTIONS_SQL} SELECT (SELECT count(*) FROM machine) AS n_machines,
    (SELECT count(DISTINCT model) FROM machine) AS n_models, count(*) AS n_maintenances,
    count(*) FILTER (WHERE maintenance_type = 'proactive') AS n_proactive,
    count(*) FILTER (WHERE maintenance_type = 'reactive') AS n_reactive,
    round(avg(CAST(duration_hours AS DOUBLE)), 2) AS mean_duration_h FROM intervention""",
)
def maint_metrics(spark, sf):
    return checks.reference_metrics(machines(spark, sf), interventions(spark, sf))


@query(
    "capacity_check",
    f"""WITH {MACHINES_SQL}, r AS (SELECT *, max_daily_capacity / CAST(max_hourly_capacity_pieces AS DOUBLE) AS ratio FROM machine)
    SELECT machine_code, CAST(round_even(ratio, 0) AS INTEGER) AS heures_equivalentes_jour,
      abs(ratio - (SELECT quantile_cont(ratio, 0.5) FROM r)) > 1.0 AS capacite_incoherente FROM r""",
)
def capacity_check(spark, sf):
    m = machines(spark, sf)
    cols = capacity_columns(capacity_ratio_median(m))
    return m.select("machine_code", *[c.alias(n) for n, c in cols.items()])

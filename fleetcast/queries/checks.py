"""Integrity, constraints, reconciliation and upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.operators import checks
from fleetcast.operators.stats import personal_columns
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
from fleetcast.operators.quality import dedup_first
from fleetcast.sources.sinks import (
    append,
    log_metrics,
    new_path,
    overwrite,
    read_ledger,
    reconcile,
    upsert,
    write_csv,
)
from fleetcast.sources.tables import CsvSource, read_csv_source, read_table
from fleetcast.session import scratch_dir


@query(
    "qa_orphans",
    f"""WITH {MACHINES_SQL}, {INTERVENTIONS_SQL} SELECT DISTINCT machine_code FROM intervention
    WHERE machine_code NOT IN (SELECT machine_code FROM machine)""",
)
def qa_orphans(spark, sf):
    return checks.orphans(interventions(spark, sf), machines(spark, sf), "machine_code")


@query(
    "qa_integrity",
    f"""WITH {MACHINES_SQL}, {INTERVENTIONS_SQL},
    r AS (SELECT max_daily_capacity / CAST(max_hourly_capacity_pieces AS DOUBLE) AS ratio FROM machine),
    q AS (SELECT quantile_cont(ratio, 0.5) AS mid FROM r)
    SELECT (SELECT count(machine_code) = count(DISTINCT machine_code) FROM machine) AS machine_pk_unique,
      count(maintenance_id) = count(DISTINCT maintenance_id) AS maintenance_pk_unique,
      count(*) FILTER (WHERE maintenance_type = 'reactive' AND related_incident_id IS NULL) AS n_reactive_without_incident,
      count(DISTINCT machine_code) FILTER (WHERE machine_code NOT IN (SELECT machine_code FROM machine)) AS n_orphan_machines,
      (SELECT count(*) FROM r, q WHERE abs(ratio - mid) > 1.0) AS n_capacity_incoherent,
      (SELECT mid FROM q) AS capacity_ratio_median, CAST(0 AS INTEGER) AS n_personal_columns
    FROM intervention""",
)
def qa_integrity(spark, sf):
    m, i = machines(spark, sf), interventions(spark, sf)
    return checks.check_integrity(m, i, personal_columns(m) + personal_columns(i))


@query(
    "qa_constraints",
    f"""WITH {MACHINES_SQL}, {INTERVENTIONS_SQL}
    SELECT 'duration_positive' AS rule, count(*) FILTER (WHERE NOT duration_hours > 5) AS n_violations FROM intervention
    UNION ALL SELECT 'type_known', count(*) FILTER (WHERE maintenance_type NOT IN ('proactive', 'reactive')) FROM intervention
    UNION ALL SELECT 'machine_present', count(*) FILTER (WHERE machine_code IS NULL) FROM intervention
    UNION ALL SELECT 'maintenance_id_unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM intervention GROUP BY maintenance_id)
    UNION ALL SELECT 'machine_fk', count(*) FROM intervention WHERE machine_code NOT IN (SELECT machine_code FROM machine)""",
)
def qa_constraints(spark, sf):
    m, i = machines(spark, sf), interventions(spark, sf)
    rows = checks.constraint_report(
        i,
        {
            "duration_positive": F.col("duration_hours") > 5,
            "type_known": F.col("maintenance_type").isin("proactive", "reactive"),
            "machine_present": F.col("machine_code").isNotNull(),
        },
    )
    unique = checks.unique_violations(i, ["maintenance_id"], "maintenance_id_unique")
    fk = checks.foreign_key_violations(i, m, "machine_code", "machine_code", "machine_fk")
    return rows.unionByName(unique).unionByName(fk)


@query(
    "qa_reconcile",
    f"""WITH {DEDUP_SQL} SELECT 'lineitem' AS table_name, (SELECT count(*) FROM lineitem) AS n_raw, count(*) AS n_loaded,
    (SELECT count(*) FROM lineitem) = count(*) AS matches FROM dedup
    UNION ALL SELECT 'orders', count(*), count(*), true FROM orders""",
)
def qa_reconcile(spark, sf):
    line, orders = telemetry(spark, sf), read_table(spark, sf, "orders")
    loaded = dedup_first(line, ["l_suppkey", "l_shipdate"], LINE_TIES)
    path = new_path(scratch_dir(spark), "reload")
    overwrite(orders, path)
    return reconcile({"lineitem": line, "orders": orders}, {"lineitem": loaded, "orders": spark.read.parquet(path)})


# --- sinks -----------------------------------------------------------------------------------


@query("src_csv_roundtrip", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def src_csv_roundtrip(spark, sf):
    events = read_table(spark, sf, "events")
    path = new_path(scratch_dir(spark), "csv")
    write_csv(events, path)
    source = CsvSource("events", path, "events", events.schema, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return read_csv_source(spark, source)


@query("snk_overwrite_idempotent", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def snk_overwrite_idempotent(spark, sf):
    orders = read_table(spark, sf, "orders")
    path = new_path(scratch_dir(spark), "overwrite")
    for _ in range(2):
        overwrite(orders, path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("snk_append", "SELECT o_orderpriority, 2 * count(*) AS n FROM orders GROUP BY 1")
def snk_append(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    path = new_path(scratch_dir(spark), "append")
    for _ in range(2):
        append(orders, path)
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_upsert",
    """WITH new AS (SELECT * FROM (SELECT s_suppkey, s_name || '*' AS s_name, s_nationkey, s_acctbal,
      row_number() OVER (PARTITION BY s_suppkey ORDER BY s_acctbal) AS rn FROM (
        SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 2 AS s_acctbal FROM supplier WHERE s_acctbal > 5000
        UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal * 3 FROM supplier WHERE s_acctbal > 5000
        UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier)) WHERE rn = 1)
    SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM new
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
      WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new)""",
)
def snk_upsert(spark, sf):
    old = read_table(spark, sf, "supplier")
    rich = old.filter("s_acctbal > 5000")
    new = (
        rich.withColumn("s_acctbal", F.col("s_acctbal") * 2)
        .unionByName(rich.withColumn("s_acctbal", F.col("s_acctbal") * 3))
        .unionByName(old.withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000))
        .withColumn("s_name", F.concat("s_name", F.lit("*")))
    )
    return rounded(upsert(old, new, ["s_suppkey"], ["s_acctbal"]), "s_acctbal", digits=2)


@query(
    "qa_run_metrics",
    """SELECT 'run-' || i AS run_id, 'orders' AS pipeline,
    printf('{"n_rows":%d,"n_status":%d}', (SELECT count(*) FROM orders), (SELECT count(DISTINCT o_orderstatus) FROM orders)) AS metrics
    FROM (SELECT unnest([1, 2]) AS i)""",
)
def qa_run_metrics(spark, sf):
    metrics = read_table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderstatus").alias("n_status")
    )
    path = new_path(scratch_dir(spark), "ledger")
    for run in ("run-1", "run-2"):
        log_metrics(metrics, path, run, "orders")
    return read_ledger(spark, path)

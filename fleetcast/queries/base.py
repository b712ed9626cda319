"""Query registry and the mapping of generic roles onto the given tables.

The same mapping is written twice on purpose: as DataFrames for Spark and as CTE text for
the SQL twins, so that neither side can lean on the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.functions.time import micros
from fleetcast.roles import Roles
from fleetcast.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with its optional SQL twin."""

    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return keep


def _load() -> None:
    from fleetcast.queries import (  # noqa: F401
        checks,
        evaluation,
        features,
        layers,
        governance,
        learning,
        logs,
        measures,
        tables,
        timelines,
    )


def registered() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round floating results for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- A. machine log on events ------------------------------------------------------------
# entity = user, readings = view/click/purchase, incidents = error, maintenance = signup for
# value/10 hours (to the minute). s1 is missing below the detection limit of 5.
LOG = Roles(
    entity="user_id",
    sensors=("s1", "s2"),
    production="pieces",
    windows_h=(6, 24, 48),
)

_K = "CAST(get_json_object(props, '$.k') AS DOUBLE)"


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").withColumn("us", micros("ts"))


def log_readings(spark: SparkSession, sf: str) -> DataFrame:
    ev = log_events(spark, sf).filter(F.col("event_type").isin("view", "click", "purchase"))
    k = F.expr(_K)
    return ev.select(
        "event_id",
        "user_id",
        "us",
        "ts",
        F.when(F.col("value") >= 5, F.col("value")).alias("s1"),
        k.alias("s2"),
        k.cast("long").alias("pieces"),
    )


def log_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return log_events(spark, sf).filter("event_type = 'error'").select("user_id", "us", "event_id")


def log_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    ev = log_events(spark, sf).filter("event_type = 'signup'")
    minutes = F.round(F.col("value") * 6).cast("long")
    return ev.select("user_id", "us", (F.col("us") + minutes * 60_000_000).alias("end_us"))


LOG_SQL = """
readings AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, ts,
         CASE WHEN value >= 5 THEN value END AS s1,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS s2,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS pieces
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
incidents AS (
  SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE event_type = 'error'),
maintenance AS (
  SELECT user_id, epoch_us(ts) AS us,
         epoch_us(ts) + CAST(round(value * 6) AS BIGINT) * 60000000 AS end_us
  FROM events WHERE event_type = 'signup')
"""

# readings with segment and interval membership, by correlated subqueries
SEGMENT_SQL = (
    LOG_SQL
    + """,
located AS (
  SELECT r.*,
         (SELECT count(*) FROM maintenance m
           WHERE m.user_id = r.user_id AND m.us <= r.us) AS segment,
         EXISTS (SELECT 1 FROM maintenance m
           WHERE m.user_id = r.user_id AND m.us <= r.us AND r.us < m.end_us) AS during_maintenance
  FROM readings r)
"""
)

# --- B. multi-sensor telemetry on lineitem -------------------------------------------------
# entity = supplier, time = ship date, four sensors; duplicated (entity, time) keys are real.
WIDE = Roles(
    entity="l_suppkey",
    sensors=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    production="l_linenumber",
)
LINE_TIES = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
)


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem")


# one row per (entity, time), the first by all other columns
DEDUP_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey,
    l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
    l_linestatus) AS rn FROM lineitem),
dedup AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)
"""

# --- D. incident reports on orders and customer -----------------------------------------
# severity = first digit of the priority, machine = nation, three signal flags; the comment
# is missing on cheap orders, a few flags exceed 1 and the clock is invalid for urgent ones.


def reports(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    cust = read_table(spark, sf, "customer")
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey)
    sev = F.substring("o_orderpriority", 1, 1).cast("int")
    price = F.col("o_totalprice")
    hour = F.least(F.floor(price / 21_000), F.lit(23)).cast("long")
    return joined.select(
        F.col("o_orderkey").alias("incident_id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(sev == 1, F.lit("25:00"))
        .otherwise(F.format_string("%02d:00", hour))
        .alias("time"),
        F.col("c_name").alias("operator_name"),
        F.concat(F.lit("B"), F.col("o_custkey").cast("string")).alias("operator_badge"),
        F.when(F.col("c_nationkey") < 20, F.format_string("MACH-%02d", F.col("c_nationkey")))
        .otherwise(F.concat(F.lit("X-"), F.col("c_nationkey").cast("string")))
        .alias("machine_id"),
        F.when(F.col("c_acctbal") < -900, F.lit(None))
        .when(F.col("c_acctbal") > 9900, F.lit(6))
        .otherwise(sev)
        .alias("severity"),
        F.when(price >= 20000, F.concat_ws(" ", "c_mktsegment", "o_orderstatus")).alias("comment"),
        F.when(hour.between(6, 13), "matin")
        .when(hour.between(14, 21), "apres-midi")
        .otherwise("nuit")
        .alias("_team"),
        F.col("o_orderstatus").alias("status"),
        hour.alias("hour"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0).alias("type_heat"),
        F.when(F.col("o_orderstatus") == "F", 1)
        .when(F.col("c_acctbal") > 9950, 2)
        .otherwise(0)
        .alias("type_pressure"),
        F.when(F.col("c_acctbal") > 5000, 1).otherwise(0).alias("type_noise"),
    ).withColumn(
        # one team in a few reports contradicts the clock
        "shift",
        F.when((F.col("status") == "P") & (F.col("severity") == 5), "nuit").otherwise(F.col("_team")),
    ).drop("_team")


REPORT_FLAGS = ("type_heat", "type_pressure", "type_noise")

REPORTS_SQL = """
base AS (
  SELECT o.*, c.*, CAST(least(floor(o_totalprice / 21000), 23) AS BIGINT) AS hour,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS sev
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
reports0 AS (
  SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN sev = 1 THEN '25:00' ELSE printf('%02d:00', hour) END AS time,
    c_name AS operator_name, 'B' || o_custkey AS operator_badge,
    CASE WHEN c_nationkey < 20 THEN printf('MACH-%02d', c_nationkey)
         ELSE 'X-' || c_nationkey END AS machine_id,
    CASE WHEN c_acctbal < -900 THEN NULL WHEN c_acctbal > 9900 THEN 6 ELSE sev END AS severity,
    CASE WHEN o_totalprice >= 20000 THEN c_mktsegment || ' ' || o_orderstatus END AS comment,
    o_orderstatus AS status, hour,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS type_heat,
    CASE WHEN o_orderstatus = 'F' THEN 1 WHEN c_acctbal > 9950 THEN 2 ELSE 0 END AS type_pressure,
    CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END AS type_noise
  FROM base),
reports AS (
  SELECT *, CASE WHEN status = 'P' AND severity = 5 THEN 'nuit'
    WHEN hour BETWEEN 6 AND 13 THEN 'matin' WHEN hour BETWEEN 14 AND 21 THEN 'apres-midi'
    ELSE 'nuit' END AS shift
  FROM reports0)
"""

# --- C. machines and maintenance reference tables --------------------------------------
# machine = supplier (model = nation, location = region), maintenance log = orders by
# customer account; some maintenance rows point at machines that do not exist.


def machines(spark: SparkSession, sf: str) -> DataFrame:
    supplier = read_table(spark, sf, "supplier")
    nation = read_table(spark, sf, "nation")
    region = read_table(spark, sf, "region")
    hourly = F.lit(40) + F.col("s_nationkey")
    base = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return base.select(
        F.format_string("MACH-%06d", F.col("s_suppkey")).alias("machine_code"),
        F.date_add(F.lit("2015-01-01").cast("date"), (F.col("s_nationkey") * 97).cast("int")).alias(
            "commissioning_date"
        ),
        F.when(F.col("s_acctbal") > 9000, hourly * 20).otherwise(hourly * 16).alias(
            "max_daily_capacity"
        ),
        hourly.alias("max_hourly_capacity_pieces"),
        F.col("n_name").alias("model"),
        F.concat(F.lit("LINE-"), F.col("n_regionkey").cast("string")).alias("production_line"),
        F.col("r_name").alias("location"),
        F.when(F.col("s_acctbal") < 2000, "LOW")
        .when(F.col("s_acctbal") < 7000, "MEDIUM")
        .otherwise("HIGH")
        .alias("criticality"),
    )


MACHINES_SQL = """
machine AS (
  SELECT printf('MACH-%06d', s_suppkey) AS machine_code,
    CAST(DATE '2015-01-01' + CAST(s_nationkey * 97 AS INTEGER) AS DATE) AS commissioning_date,
    CAST((40 + s_nationkey) * CASE WHEN s_acctbal > 9000 THEN 20 ELSE 16 END AS INTEGER)
      AS max_daily_capacity,
    CAST(40 + s_nationkey AS INTEGER) AS max_hourly_capacity_pieces,
    n_name AS model, 'LINE-' || n_regionkey AS production_line, r_name AS location,
    CASE WHEN s_acctbal < 2000 THEN 'LOW' WHEN s_acctbal < 7000 THEN 'MEDIUM' ELSE 'HIGH' END
      AS criticality
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
"""


def interventions(spark: SparkSession, sf: str) -> DataFrame:
    line = read_table(spark, sf, "lineitem")
    reactive = F.col("l_returnflag") == "R"
    return line.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("maintenance_id"),
        # returned goods of discount 0.1 name a machine outside the register
        F.when(reactive & (F.col("l_discount") >= 0.1), F.format_string("LOST-%06d", F.col("l_suppkey")))
        .otherwise(F.format_string("MACH-%06d", F.col("l_suppkey")))
        .alias("machine_code"),
        F.col("l_shipdate").alias("maintenance_at"),
        F.when(reactive, "reactive").otherwise("proactive").alias("maintenance_type"),
        F.format_string("component-%02d", F.col("l_linenumber")).alias("component"),
        F.when(reactive & (F.col("l_tax") < 0.07), F.concat(F.lit("INC-"), F.col("l_orderkey").cast("string")))
        .alias("related_incident_id"),
        (F.col("l_quantity") / 4).cast("decimal(6,2)").alias("duration_hours"),
    )


INTERVENTIONS_SQL = """
intervention AS (
  SELECT l_orderkey || '-' || l_linenumber AS maintenance_id,
    CASE WHEN l_returnflag = 'R' AND l_discount >= 0.1 THEN printf('LOST-%06d', l_suppkey)
         ELSE printf('MACH-%06d', l_suppkey) END AS machine_code,
    l_shipdate AS maintenance_at,
    CASE WHEN l_returnflag = 'R' THEN 'reactive' ELSE 'proactive' END AS maintenance_type,
    printf('component-%02d', l_linenumber) AS component,
    CASE WHEN l_returnflag = 'R' AND l_tax < 0.07 THEN 'INC-' || l_orderkey END
      AS related_incident_id,
    CAST(l_quantity / 4 AS DECIMAL(6,2)) AS duration_hours
  FROM lineitem)
"""

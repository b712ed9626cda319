"""Clean layer and feature matrix end to end, contracts, sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetcast.operators.contract import (
    build_contract,
    column_types,
    compare_schemas,
    load_contract,
    save_contract,
    schema_drift,
    schema_from_text,
    schema_text,
)
from fleetcast.operators.stats import profile
from fleetcast.plans.gold import build_gold, matrix_metrics
from fleetcast.plans.silver import build_silver
from fleetcast.roles import HORIZONS_H, INCIDENT_SIGNALS, SENSOR_UNITS
from fleetcast.sources import sinks
from fleetcast.sources.tables import CsvSource, preview_csv, read_csv_source, read_layer, read_matrix
from tests.helpers import hour

SENSORS = list(SENSOR_UNITS)


PRESS = {0: 61.0, 2: None, 4: None, 6: 67.0, 8: None, 10: 99.0, 12: 72.0, 14: None}  # hour: temperature
LATHE = {1: None, 3: 30.5, 5: 31.5, 7: None, 9: 33.5}


def plant(spark):
    """A press with two overlapping repairs (07:00 to 09:30 and 09:00 to 11:00), a lathe without any,
    a report from a machine nobody knows, and a reading sent twice."""
    sent = [("PRESS-7", h, t) for h, t in PRESS.items()] + [("LATHE-2", h, t) for h, t in LATHE.items()]
    sent.append(("PRESS-7", 0, 61.0))
    telemetry = ", ".join(
        f"({i}, '{m}', {h}, {'NULL' if t is None else t}, {200 + 3 * h}, {231 - h / 4}, {900 + 7 * h}, {h % 5})" for i, (m, h, t) in enumerate(sent, 1)
    )
    names = ", ".join(["telemetry_id", "machine_id", "h", *SENSORS, "pieces_produced"])
    start = "TIMESTAMP_NTZ '2025-03-30 00:00:00'"
    flags = ", ".join(f"CASE WHEN n % {k} = 0 THEN 1 ELSE 0 END AS {s}" for k, s in enumerate(INCIDENT_SIGNALS, 2))
    doubles = ", ".join(f"CAST({s} AS DOUBLE) AS {s}" for s in SENSORS)
    return {
        "telemetry": spark.sql(
            f"SELECT telemetry_id, machine_id, {start} + make_interval(0, 0, 0, 0, h) AS timestamp, {doubles}, pieces_produced FROM VALUES {telemetry} AS t({names})"
        ),
        "machine": spark.sql(
            """SELECT code AS machine_code, CAST(since AS DATE) AS commissioning_date, 20 * hourly AS max_daily_capacity,
               hourly AS max_hourly_capacity_pieces, model, line AS production_line, 'Nord' AS location, 'LOW' AS criticality, true AS is_active
               FROM VALUES ('PRESS-7', '2019-11-03', 32, 'Kappa', 'L9'), ('LATHE-2', '2022-02-28', 18, 'Sigma', 'L4') AS t(code, since, hourly, model, line)"""
        ),
        "maintenance": spark.sql(
            """SELECT id AS maintenance_id, 'PRESS-7' AS machine_code, CAST(at AS TIMESTAMP) AS maintenance_at, kind AS maintenance_type,
               'replace' AS action_type, part AS component, CAST(NULL AS STRING) AS description, incident AS related_incident_id,
               CAST(hours AS DECIMAL(6, 2)) AS duration_hours
               FROM VALUES (31, '2025-03-30 07:00:00', 'reactive', 'belt', 'R-5', 2.5), (32, '2025-03-30 09:00:00', 'proactive', 'valve', NULL, 2)
               AS t(id, at, kind, part, incident, hours)"""
        ),
        "incident": spark.sql(
            f"""SELECT CAST(n AS INT) AS incident_pk, concat('R-', n) AS incident_id, DATE '2025-03-30' AS date, clock AS time, 'someone' AS operator_name,
               machine AS machine_id, 1 + CAST(n % 5 AS INT) AS severity, 'badge' AS operator_badge, CAST(NULL AS STRING) AS comment, 'nuit' AS shift, {flags}
               FROM VALUES (5, '06:40', 'PRESS-7'), (6, '13:10', 'LATHE-2'), (7, '13:20', 'GHOST') AS t(n, clock, machine)"""
        ),
    }


def test_clean_layer_of_a_plant(spark, chunks, tmp_path):
    out = build_silver(plant(spark))
    reading = out["reading"].join(out["machine"].select("machine_pk", "machine_code"), "machine_pk").orderBy("machine_code", "timestamp")
    rows = [r.asDict() for r in reading.collect()]
    assert sorted(r["reading_id"] for r in rows) == list(range(1, len(PRESS) + len(LATHE) + 1))
    lathe, press = rows[: len(LATHE)], rows[len(LATHE) :]
    assert [r["machine_code"] for r in lathe] == ["LATHE-2"] * 5 and not any(r["during_maintenance"] for r in lathe)
    assert [r["during_maintenance"] for r in press] == [h in (8, 10) for h in PRESS]
    m = out["measurement"]
    assert m.columns == ["reading_id", "sensor_id", "value", "was_imputed", "is_outlier", "is_saturated"] and m.count() == 13 * len(SENSORS)
    temperature = {r["reading_id"]: (r["value"], r["was_imputed"]) for r in m.filter("sensor_id = 1").collect()}
    assert [temperature[r["reading_id"]] for r in press] == [
        (61.0, False), (63.0, True), (65.0, True), (67.0, False),  # thirds of the way
        (None, False), (99.0, False),  # under repair nothing is filled in
        (72.0, False), (72.0, True),  # the last value is held, the one under repair is not used
    ]
    assert [temperature[r["reading_id"]] for r in lathe] == [(30.5, True), (30.5, False), (31.5, False), (32.5, True), (33.5, False)]
    known = {r["incident_id"]: r["machine_pk"] for r in out["incident"].collect()}
    pk = {r["machine_code"]: r["machine_pk"] for r in out["machine"].collect()}
    assert known == {"R-5": pk["PRESS-7"], "R-6": pk["LATHE-2"], "R-7": None}
    for table, gone in {"incident": ("operator_name", "operator_badge", "date", "time", "machine_id"), "maintenance": ("component", "machine_code", "action_type"), "machine": ("model",)}.items():
        assert not set(gone) & set(out[table].columns), table
    naive = {t: [c for c, kind in out[t].dtypes if kind == "timestamp_ntz"] for t in ("reading", "maintenance", "machine", "incident")}
    assert naive == {"reading": ["timestamp"], "maintenance": ["maintenance_at"], "machine": ["commissioning_date"], "incident": ["timestamp"]}
    keys = [("measurement", "reading_id", "reading", "reading_id"), ("incident", "machine_pk", "machine", "machine_pk")]
    assert {r["n_violations"] for r in sinks.write_layer(out, str(tmp_path), keys).collect()} == {0}
    back = read_layer(spark, str(tmp_path.parent), tmp_path.name, ["reading", "measurement"])
    assert back["measurement"].exceptAll(m).isEmpty() and back["reading"].count() == 13


def workshop(spark):
    """Clean tables of three machines, a reading every 90 minutes, 30 each. Machine 2 is repaired from 12:00
    to 16:00, in which the readings of 12:00, 13:30 and 15:00 fall; machine 3 has no incident at all."""
    at = lambda minutes: f"TIMESTAMP_NTZ '2024-02-28 00:00:00' + make_interval(0, 0, 0, 0, 0, {minutes})"
    grid = spark.range(90).selectExpr("CAST(id AS INT) AS n", "CAST(id % 3 + 1 AS INT) AS machine_pk", "CAST(id DIV 3 AS INT) AS k")
    reading = grid.selectExpr(
        "n + 1 AS reading_id", "machine_pk", f"{at('90 * k')} AS timestamp", "machine_pk = 2 AND 90 * k >= 720 AND 90 * k < 960 AS during_maintenance", "CAST(k * k % 11 AS INT) AS pieces_produced"
    )
    sensor = spark.createDataFrame([(i, s) for i, s in enumerate(SENSORS, 1)], "sensor_id int, name string")
    measurement = grid.crossJoin(sensor).selectExpr(
        "n + 1 AS reading_id", "sensor_id", "IF(k = 4 AND sensor_id = 2, NULL, sensor_id * 100 + sin(k) * machine_pk) AS value", "k IN (3, 17) AS was_imputed", "k = 9 AS is_outlier", "machine_pk = 3 AND k > 25 AS is_saturated"
    )
    return {
        "reading": reading,
        "measurement": measurement,
        "sensor": sensor,
        "machine": spark.sql(
            """SELECT pk AS machine_pk, concat('W', pk) AS machine_code, IF(pk = 3, 'Tau', 'Rho') AS model, 'MEDIUM' AS criticality, 'P' AS production_line,
               'Sud' AS location, 10 * pk AS max_hourly_capacity_pieces, date_sub(DATE '2024-02-28', 100 * pk) AS commissioning_date FROM VALUES (1), (2), (3) AS t(pk)"""
        ),
        "maintenance": spark.sql(f"SELECT 8 AS maintenance_id, 2 AS machine_pk, {at(720)} AS maintenance_at, 4D AS duration_hours"),
        "incident": spark.sql(f"SELECT 1 AS id, 1 AS machine_pk, {at(1000)} AS timestamp UNION ALL SELECT 2, 2, {at(2600)}"),
    }


def test_matrix_of_a_workshop(spark, chunks, tmp_path):
    df = build_gold(workshop(spark))
    rows = df.collect()
    assert len(rows) == 87 and len(df.columns) == 127  # three under repair are left out; the published width
    labels = [f"label_incident_{h}h" for h in HORIZONS_H]
    assert {*labels, "rul_hours", "rul_censored", "split", "utilisation", "age_days", "hour_sin", "shift", "temperature_c_mean_24h", "n_saturated_6h"} <= set(df.columns)
    assert not {"during_maintenance", "segment", "reading_id", "us"} & set(df.columns)
    assert [c for c in df.columns if c.startswith("_") or c.endswith("_was_imputed")] == []
    seen = {}
    for r in rows:
        assert (r["rul_hours"] is None) == (r["rul_censored"] == 1)
        near = [r[x] for x in labels]
        assert near == sorted(near)
        hit = seen.setdefault(r["age_days"] // 100, [0, 0])
        hit[0] += r["rul_censored"]
        hit[1] += r[labels[0]]
    # machine 1: 12 readings from 0:00 to 16:30 come before its incident of 16:40, of which the last 4 within 6 h
    assert seen[1] == [30 - 12, 4] and seen[3] == [30, 0]
    assert seen[2] == [1, 4]  # its incident is at 43:20, the last reading at 43:30
    m = matrix_metrics(df, HORIZONS_H).first()
    assert (m["n_rows"], m["n_features"], m["n_train"] + m["n_val"] + m["n_test"]) == (87, 118, 87)
    df.write.parquet(str(tmp_path / "m"))
    assert read_matrix(spark, str(tmp_path / "m"), "parquet").count() == 87


# --- contracts -----------------------------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([(7, "p", None), (7, None, None), (8, "q", None), (9, "q", None)], "u int, w string, empty string")
    for approximate in (False, True):
        out = {r["column"]: (r["type"], r["non_null"], r["n_unique"]) for r in profile(df, approximate).collect()}
        assert out == {"u": ("int", 4, 3), "w": ("string", 3, 2), "empty": ("string", 0, 0)}


def test_schema_diff_and_drift(spark, tmp_path):
    before = spark.createDataFrame([(1.5, True, None)], "weight double, sealed boolean, note string")
    after = spark.createDataFrame([("1.5", None, None)], "weight string, note string, lot long")
    assert {tuple(r)[:2] for r in compare_schemas(column_types(before), column_types(after)).select("column", "change").collect()} == {
        ("weight", "retyped"), ("sealed", "removed"), ("lot", "added"),
    }
    assert compare_schemas(column_types(before), column_types(before)).isEmpty()
    save_contract(build_contract({"parcels": before, "crates": before}), str(tmp_path / "c"))
    ref = load_contract(spark, str(tmp_path / "c"))
    assert schema_drift(ref, build_contract({"crates": before, "parcels": before})).isEmpty()
    told = schema_drift(ref, build_contract({"parcels": before, "pallets": after})).collect()
    assert {(r["source"], r["change"]) for r in told} == {("crates", "vanished_source"), ("pallets", "new_source")}
    assert schema_from_text(schema_text(after)) == after.schema


# --- sinks -------------------------------------------------------------------------------------


def test_overwrite_append_upsert(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.overwrite(df, path)
    assert spark.read.parquet(path).count() == 2
    sinks.append(df, path)
    assert spark.read.parquet(path).count() == 4
    new = spark.createDataFrame([(2, "z"), (2, "y"), (3, "c")], "k int, v string")
    got = sorted((r["k"], r["v"]) for r in sinks.upsert(df, new, ["k"], ["v"]).collect())
    assert got == [(1, "a"), (2, "y"), (3, "c")]


def test_partition_overwrite_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    sinks.overwrite(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"])
    assert sorted((r["v"], r["p"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


def test_runs_ledger_csv_reconcile(spark, tmp_path):
    df = spark.createDataFrame([(1, hour(1))], "k int, t timestamp_ntz")
    sinks.write_run(df, str(tmp_path / "r"), "202501010000")
    sinks.write_run(df.withColumn("k", F.lit(5)), str(tmp_path / "r"), "202501020000")
    assert sinks.read_run(spark, str(tmp_path / "r")).first()["k"] == 5
    assert sinks.read_run(spark, str(tmp_path / "r"), "202501010000").first()["k"] == 1
    sinks.write_csv(df, str(tmp_path / "c"))
    back = read_csv_source(spark, CsvSource("x", str(tmp_path / "c"), "x", df.schema, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert back.collect() == df.collect()
    sinks.log_metrics(df.agg(F.count("k").alias("n")), str(tmp_path / "l"), "r1", "p")
    assert sinks.read_ledger(spark, str(tmp_path / "l")).first()["metrics"] == '{"n":1}'
    rec = sinks.reconcile({"a": df}, {"a": df, "b": df}).collect()
    assert {r["table_name"]: r["matches"] for r in rec} == {"a": True, "b": False}


def test_preview_and_replaced_table(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text("n,label\n4,x\n5,y\n6,z\n")
    seen = preview_csv(spark, str(folder))
    assert seen.dtypes == [("n", "int"), ("label", "string")] and [tuple(r) for r in seen.collect()] == [(4, "x"), (5, "y"), (6, "z")]
    for k in (1, 2):
        sinks.replace_table(spark.range(k), "tests_replaced")
    assert read_matrix(spark, "tests_replaced", "table").count() == 2
    spark.sql("DROP TABLE tests_replaced")


def test_matrix_source_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        read_matrix(spark, str(tmp_path), "csv")

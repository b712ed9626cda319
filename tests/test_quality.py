"""Sensor checks, dedup, rule checks, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetcast.functions.time import micros
from fleetcast.operators import checks, quality
from fleetcast.operators.conform import drop_identifiers, enrich_incidents, pii_scan, report_confidence
from fleetcast.operators.stats import pearson, spearman
from fleetcast.roles import INCIDENT_SIGNALS, SENSOR_UNITS
from tests.helpers import by, frame, hour

SENSORS = list(SENSOR_UNITS)
SCHEMA = "machine_id string, timestamp timestamp_ntz, " + ", ".join(f"{s} double" for s in SENSORS) + ", pieces_produced int"


def kilns(spark):
    """Three kilns, a reading every 40 minutes for a day; each sensor its own wave, kiln by kiln a little apart."""
    wave = "FROM (SELECT explode(sequence(0, 35)) AS k) CROSS JOIN VALUES ('KILN-A', 0), ('KILN-B', 1), ('KILN-C', 2) AS t(machine_id, o)"
    df = spark.sql(
        f"""SELECT machine_id, TIMESTAMP_NTZ '2023-11-05 06:00:00' + make_interval(0, 0, 0, 0, 0, 40 * k) AS timestamp,
        900 + 25 * sin(k / 4) + o AS temperature_c, 3 + cos(k / 7 + o) AS pressure_bar, 400 - k / 9 AS voltage_mean_v,
        60 + 11 * sin(k * k) AS rotation_mean_rpm, CAST(k DIV 3 AS INT) AS pieces_produced {wave}"""
    )
    return df.withColumns({s: F.col(s).cast("double") for s in SENSORS}).withColumn("us", micros("timestamp"))


def test_pii_scan(spark):
    named = kilns(spark).withColumns({"Operator_Shoe": F.lit(41), "batch_name": F.lit(None).cast("string"), "colour": F.lit("red")})
    assert {r["column"] for r in pii_scan(named).collect() if r["is_pii"]} == {"Operator_Shoe", "batch_name"}
    assert {r["column"] for r in pii_scan(named, allow=["batch_name"]).collect() if r["is_pii"]} == {"Operator_Shoe"}
    assert not any(r["is_pii"] for r in pii_scan(kilns(spark)).collect())


def test_dedup_keeps_the_first(spark):
    df = kilns(spark)
    colder = df.filter("machine_id <> 'KILN-C'").withColumn("temperature_c", F.col("temperature_c") - 500)
    out = quality.dedup_first(df.unionByName(colder), ["machine_id", "timestamp"], ["temperature_c"])
    assert out.columns == df.columns and out.count() == 108
    assert {(r["machine_id"], r["n"]) for r in out.filter("temperature_c < 600").groupBy("machine_id").agg(F.count("*").alias("n")).collect()} == {
        ("KILN-A", 36), ("KILN-B", 36),
    }


def test_outlier_bounds_and_flags(spark, chunks):
    df = kilns(spark)
    hole = df.withColumn("rotation_mean_rpm", F.when(F.col("pieces_produced") == 7, -400.0).otherwise(F.col("rotation_mean_rpm")))
    marked = quality.flag_outliers(hole, SENSORS)
    assert marked.filter("rotation_mean_rpm_is_outlier").count() == 9  # three readings of three kilns
    assert marked.filter("rotation_mean_rpm_is_outlier AND pieces_produced <> 7").isEmpty()
    told = by(quality.detect_outliers(hole, SENSORS), "measure")
    assert [r["measure"] for r in told] == sorted(SENSORS)
    assert all(r["low"] < r["high"] for r in told)
    assert {r["measure"]: round(r["pct"], 6) for r in told}["rotation_mean_rpm"] == round(900 / 108, 6)


def test_mixed_units_are_suspect(spark):
    df = kilns(spark)
    assert not [r for r in quality.unit_consistency(df, "machine_id", SENSORS).collect() if r["unit_suspect"]]
    in_psi = df.withColumn("pressure_bar", F.col("pressure_bar") * F.when(F.col("machine_id") == "KILN-B", 14.5).otherwise(1.0))
    suspect = {r["measure"]: r["unit_suspect"] for r in quality.unit_consistency(in_psi, "machine_id", SENSORS).collect()}
    assert suspect == {s: s == "pressure_bar" for s in SENSORS}


def test_saturation_is_a_pile_up_not_a_ramp(spark):
    # the sensor stops at its lower end: five readings at 12.5, the others apart; voltage is a ramp, rpm never moves
    low = [12.5, 80.0, 12.5, 71.0, 12.5, 64.5, 12.5, 93.0, 12.5, 55.5, 47.0]
    df = frame(spark, [("D", hour(3 * i), v, 5.0 + i % 2, 100.0 - 2 * i, 7.0, 1) for i, v in enumerate(low)], SCHEMA)
    out = by(quality.flag_saturation(df, SENSORS), "us")
    assert [r["temperature_c_is_saturated"] for r in out] == [v == 12.5 for v in low]
    assert not any(r["voltage_mean_v_is_saturated"] for r in out)
    facts = {r["measure"]: r for r in quality.detect_saturation(df, SENSORS).collect()}
    assert facts["temperature_c"]["n_saturated"] == 5 and not facts["temperature_c"]["saturated_high"]
    assert not facts["rotation_mean_rpm"]["saturated_high"] and facts["voltage_mean_v"]["n_saturated"] == 0


def test_correlations(spark, chunks):
    rows = [(1.0, 1.0, -1.0), (2.0, 4.0, -2.0), (3.0, 9.0, None), (4.0, 16.0, -9.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    rho = {(r["a"], r["b"]): r["r"] for r in spearman(df, ["a", "b", "c"]).collect()}
    assert abs(rho[("a", "b")] - 1) < 1e-12 and abs(rho[("a", "c")] + 1) < 1e-12
    r = {(x["a"], x["b"]): x["r"] for x in pearson(df, ["a", "b"]).collect()}
    assert abs(r[("a", "b")] - 0.984374) < 1e-6


def test_constant_imputation(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (4.0, "a"), (10.0, "a"), (None, "b"), (99.0, "b")], "x double, part string")
    out = quality.impute_constant(df, ["x"], "median", F.col("part") == "a")
    assert out.filter("x = 3.0").count() == 1  # midpoint of 2 and 4, training rows only
    assert quality.fit_constants(df, ["x"], "mean")["x"] == 23.2


# --- reports ----------------------------------------------------------------------------------


def reports(spark):
    """Four reports of a bottling line: one signal, none, three, and one without comment."""
    signals = {"R7": ["type_bruit_mecanique"], "R8": [], "R9": INCIDENT_SIGNALS[:3], "Q1": [INCIDENT_SIGNALS[-1]]}
    facts = {
        "R7": ("2021-12-30", "13:20", "MACH-43", 2, "hums since the shift began", "matin"),
        "R8": ("2022-01-03", "00:05", "MACH-41", 4, "stopped by hand", "nuit"),
        "R9": ("2022-02-28", "21:59", "line three", 5, "leak, smell and heat", "apres-midi"),
        "Q1": ("2022-03-01", "14:00", "MACH-42", 3, None, "apres-midi"),
    }
    rows = [
        (i, date, time, f"worker of {i}", machine, severity, f"b-{i}", comment, shift, *[int(s in signals[i]) for s in INCIDENT_SIGNALS])
        for i, (date, time, machine, severity, comment, shift) in facts.items()
    ]
    schema = (
        "incident_id string, date string, time string, operator_name string, machine_id string, severity int, "
        "operator_badge string, comment string, shift string, " + ", ".join(f"{s} int" for s in INCIDENT_SIGNALS)
    )
    return spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))


def test_identifiers_are_dropped(spark):
    df = reports(spark)
    out = drop_identifiers(df)
    assert set(df.columns) - set(out.columns) == {"operator_name", "operator_badge"}
    assert drop_identifiers(out).columns == out.columns


def test_enrichment_and_confidence(spark):
    rows = {r["incident_id"]: r for r in report_confidence(enrich_incidents(drop_identifiers(reports(spark)))).collect()}
    assert {i: r["n_signals"] for i, r in rows.items()} == {"R7": 1, "R8": 0, "R9": 3, "Q1": 1}
    assert rows["R9"]["signal"] == "multiple" and rows["Q1"]["signal"] == INCIDENT_SIGNALS[-1]
    assert rows["R7"]["confidence"] == 1.0 and all(rows[i]["confidence"] < 1 for i in ("R8", "R9", "Q1"))
    # the week of 2021-12-30 is the last of its year, that of 2022-01-03 the first
    assert [rows[i]["semaine_iso"] for i in ("R7", "R8")] == ["2021-S52", "2022-S01"]
    assert str(rows["R9"]["dt"]) == "2022-02-28 21:59:00"
    for clock in ("7 pm", "24:10", None):
        assert enrich_incidents(reports(spark).withColumn("time", F.lit(clock).cast("string"))).filter("dt is not null").isEmpty()


def test_shift_partition(spark):
    clocks = [(f"{h:02d}:{m:02d}", "matin" if h in range(6, 14) else "apres-midi" if h in range(14, 22) else "nuit") for h in range(24) for m in (0, 30)]
    shifts = lambda rows: checks.check_shifts(spark.createDataFrame(rows, "time string, shift string")).first()
    whole = shifts(clocks)
    assert whole["partition_3x8"] and (whole["n_mismatched"], whole["min_hours"], whole["max_hours"]) == (0, 8, 8)
    # two reports of the afternoon are filed under the morning
    swapped = [(t, "matin" if t in ("15:30", "19:00") else s) for t, s in clocks]
    assert shifts(swapped)["n_mismatched"] >= 2
    # nobody reports between three and five
    assert not shifts([c for c in clocks if not "03:00" <= c[0] < "05:00"])["partition_3x8"]


def test_range_rule(spark):
    grades = lambda *v: checks.check_range(spark.createDataFrame([(x,) for x in v], "grade int"), "grade", 10, 14).first()
    fine = grades(14, 10, 10, 12)
    assert fine["rule_holds"] and (fine["min"], fine["max"], fine["absent_levels"], fine["n_null"]) == (10, 14, "11,13", 0)
    off = grades(9, 11, None, 15, 20, None)
    assert not off["rule_holds"] and (off["n_out_of_range"], off["n_null"]) == (3, 2)


def test_flag_rule(spark):
    df = reports(spark)
    told = checks.check_binary_flags(df, INCIDENT_SIGNALS).collect()
    assert len(told) == len(INCIDENT_SIGNALS) and all(r["binary"] and r["n_rows_without_signal"] == 1 for r in told)
    first, last = INCIDENT_SIGNALS[0], INCIDENT_SIGNALS[-1]
    broken = df.withColumn(last, F.when(F.col("severity") >= 4, -1).otherwise(F.col(last))).withColumn(first, F.col(first) * 7)
    assert {r["flag"] for r in checks.check_binary_flags(broken, INCIDENT_SIGNALS).collect() if not r["binary"]} == {first, last}
    assert {(r["flag"], r["value"], r["n"]) for r in checks.bad_flag_values(broken, INCIDENT_SIGNALS).collect()} == {(first, 7, 1), (last, -1, 2)}


# --- reference tables ---------------------------------------------------------------------------


def machine(spark, daily=(768, 800, 816)):
    rows = [(f"MACH-0{i}", daily[i - 1], [48, 50, 51][i - 1], f"X{i}") for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "machine_code string, max_daily_capacity int, max_hourly_capacity_pieces int, model string")


def maintenance(spark, codes=("MACH-01", "MACH-02", "MACH-03"), linked=True):
    rows = [
        (i, c, "reactive" if i % 2 else "proactive", ("INC-1" if linked else None) if i % 2 else None, 2.0 * i)
        for i, c in enumerate(codes, 1)
    ]
    return spark.createDataFrame(
        rows, "maintenance_id int, machine_code string, maintenance_type string, related_incident_id string, duration_hours double"
    )


def test_integrity(spark, chunks):
    ok = checks.check_integrity(machine(spark), maintenance(spark)).first()
    assert ok["machine_pk_unique"] and ok["maintenance_pk_unique"]
    assert (ok["n_orphan_machines"], ok["n_reactive_without_incident"], ok["n_capacity_incoherent"]) == (0, 0, 0)
    assert ok["capacity_ratio_median"] == 16.0
    lost = maintenance(spark, ("MACH-01", "MACH-99", "MACH-03"), linked=False)
    ko = checks.check_integrity(machine(spark, (768, 1200, 816)), lost).first()
    assert (ko["n_orphan_machines"], ko["n_reactive_without_incident"], ko["n_capacity_incoherent"]) == (1, 2, 1)


def test_maintenance_summary(spark):
    out = {r["maintenance_type"]: r for r in checks.maintenance_summary(maintenance(spark)).collect()}
    assert out["reactive"]["count"] == 2 and out["reactive"]["mean"] == 4.0 and out["reactive"]["n_linked"] == 2


def test_constraints_follow_sql(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "v int")
    out = {r["rule"]: r["n_violations"] for r in checks.constraint_report(df, {"positive": F.col("v") > 0, "present": F.col("v").isNotNull()}).collect()}
    assert out == {"positive": 1, "present": 1}

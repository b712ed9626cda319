"""Rolling features, interpolation, splits and folds."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetcast.operators import splits
from fleetcast.operators.ordered import quantiles
from fleetcast.operators.quality import interpolate
from fleetcast.operators.rolling import (
    apply_trailing,
    hours_in_segment,
    lag_features,
    production_stats,
    production_total,
    rolling_stats,
    segment_frame,
)
from fleetcast.operators.timeline import context_chunks
from fleetcast.roles import HORIZONS_H, HOUR_US, SENSOR_UNITS, WINDOWS_H, Roles
from tests.helpers import by, frame, hour

ROLES = Roles(entity="machine_pk")
SENSORS = tuple(SENSOR_UNITS)


def features(frame, roles, stats):
    return apply_trailing(
        frame,
        roles,
        [*stats, *production_stats(roles)],
        {"prod_cumul_segment": production_total(roles)},
    )


FRAME = (
    "machine_pk int, timestamp timestamp_ntz, segment int, during_maintenance boolean, "
    + ", ".join(f"{s} double" for s in SENSORS)
    + ", pieces_produced int"
)


def three_segments(spark):
    """Readings 1.5 h apart; a new segment after 4 and after 6 readings. The temperature falls by 3 an hour in
    the first one, is missing once in the second and constant in the third."""
    temps = [60.0, 55.5, 51.0, 46.5, None, 8.0, 5.0, 5.0, 5.0]
    parts = [3, 3, 3, 3, 7, 7, 9, 9, 9]
    made = [4, 0, None, 6, 1, 1, 2, 2, 2]
    rows = [(12, hour(1.5 * i), g, False, t, 2.0 * i, 1.0, -1.0, p) for i, (t, g, p) in enumerate(zip(temps, parts, made, strict=True))]
    return frame(spark, rows, FRAME)


def test_rolling_stays_in_the_segment_and_in_the_past(spark, chunks):
    frame_ = segment_frame(context_chunks(three_segments(spark), ROLES), ROLES)
    rows = by(features(frame_, ROLES, rolling_stats(ROLES)), "us")
    column = lambda name: [None if r[name] is None else round(r[name], 9) for r in rows]
    assert column("temperature_c_mean_48h") == [60.0, 57.75, 55.5, 53.25, None, 8.0, 5.0, 5.0, 5.0]
    # the fourth reading's 6 h reach back to the first, the fifth sees nothing of the segment before
    assert column("temperature_c_max_6h") == [60.0, 60.0, 60.0, 60.0, None, 8.0, 5.0, 5.0, 5.0]
    assert column("temperature_c_slope_6h") == [0.0, -3.0, -3.0, -3.0, None, 0.0, 0.0, 0.0, 0.0]
    assert column("temperature_c_std_48h")[:2] == [None, round(4.5 / 2**0.5, 9)] and column("temperature_c_std_48h")[6:] == [None, 0.0, 0.0]
    assert column("pressure_bar_slope_48h")[4:6] == [0.0, round(2 / 1.5, 9)]
    assert [r["prod_sum_24h"] for r in rows] == [4, 4, 4, 10, 1, 2, 2, 4, 6]
    assert [r["prod_cumul_segment"] for r in rows] == [4, 4, None, 10, 1, 2, 2, 4, 6]
    assert {f"temperature_c_std_{w}h" for w in WINDOWS_H} <= set(rows[0])
    begun = by(hours_in_segment(frame_, ROLES), "us")
    assert [r["hours_in_segment"] for r in begun] == [0.0, 1.5, 3.0, 4.5, 0.0, 1.5, 0.0, 1.5, 3.0]


def test_production_keeps_fractions_and_large_numbers(spark, chunks):
    part = three_segments(spark).drop("pieces_produced")
    some = segment_frame(context_chunks(part.withColumn("pieces_produced", F.lit(0.4)), ROLES), ROLES)
    rows = by(apply_trailing(some, ROLES, production_stats(ROLES)), "us")
    assert [r["prod_sum_24h"] for r in rows[:4]] == pytest.approx([0.4, 0.8, 1.2, 1.6])
    big = (1 << 53) + 1
    many = segment_frame(context_chunks(part.withColumn("pieces_produced", F.lit(big)), ROLES), ROLES)
    rows = by(apply_trailing(many, ROLES, production_stats(ROLES)), "us")
    assert [r["prod_sum_24h"] for r in rows[:4]] == [big, 2 * big, 3 * big, 4 * big]


def test_halo_does_not_grow_with_the_chunks(spark):
    # one machine, all readings inside one window
    rows = spark.range(4000).selectExpr("1 AS machine_pk", "0 AS segment", "false AS during_maintenance", "id * 40000000 AS us", "1D AS s")
    roles = Roles(entity="machine_pk", sensors=("s",))
    for parts in (4, 64):
        placed = segment_frame(context_chunks(rows, roles, parts), roles)
        assert placed.count() < 2 * 4000
        assert placed.filter("NOT _halo").count() == 4000


def test_window_excludes_a_reading_exactly_one_window_old(spark, chunks):
    rows = [(1, hour(h), 0, False, v, 1.0, 1.0, 1.0, 0) for h, v in ((0, 5.0), (6, 7.0), (11, 9.0))]
    schema = "machine_pk int, timestamp timestamp_ntz, segment int, during_maintenance boolean, " + ", ".join(
        f"{s} double" for s in SENSORS
    ) + ", pieces_produced int"
    made = segment_frame(context_chunks(frame(spark, rows, schema), ROLES), ROLES)
    out = by(apply_trailing(made, ROLES, rolling_stats(ROLES, ("mean",))), "us")
    assert [r["temperature_c_mean_6h"] for r in out] == [5.0, 7.0, 8.0]


def test_lags(spark, chunks):
    out = by(lag_features(context_chunks(three_segments(spark), ROLES), ROLES, (1, 2)), "us")
    assert [r["temperature_c_lag_1"] for r in out] == [None, 60.0, 55.5, 51.0, None, None, None, 5.0, 5.0]
    assert [r["temperature_c_lag_2"] for r in out] == [None, None, 60.0, 55.5, None, None, None, None, 5.0]


def gaps(spark, values, during=None):
    during = during or [False] * len(values)
    rows = [(1, hour(i), 0, d, v) for i, (v, d) in enumerate(zip(values, during))]
    return frame(
        spark,
        rows,
        "machine_pk int, timestamp timestamp_ntz, segment int, during_maintenance boolean, s double",
    )


ONE = Roles(entity="machine_pk", sensors=("s",))


def test_interpolation_skips_maintenance(spark, chunks):
    # under repair (second segment, first two readings) gaps stay; the gap after it is not bridged from before
    told = [(9.0, 4, False), (None, 4, False), (None, 4, False), (3.0, 4, False), (None, 5, True), (80.0, 5, True), (None, 5, False), (6.0, 5, False), (None, 5, False)]
    rows = [(2, hour(0.25 * i), seg, d, v) for i, (v, seg, d) in enumerate(told)]
    df = frame(spark, rows, "machine_pk int, timestamp timestamp_ntz, segment int, during_maintenance boolean, s double")
    out = by(interpolate(context_chunks(df, ONE), ONE), "us")
    assert [r["s"] for r in out] == [9.0, 7.0, 5.0, 3.0, None, 80.0, 6.0, 6.0, 6.0]
    assert [i for i, r in enumerate(out) if r["s_was_imputed"]] == [1, 2, 6, 8]


def test_interpolation_edges_position_and_time(spark, chunks):
    out = by(interpolate(context_chunks(gaps(spark, [None, 2.0, None, None, 8.0, None]), ONE), ONE), "us")
    assert [r["s"] for r in out] == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    empty = by(interpolate(context_chunks(gaps(spark, [None, None]), ONE), ONE), "us")
    assert [r["s"] for r in empty] == [None, None]
    # an uneven step: equal by position, proportional by time
    rows = [(1, hour(h), 0, False, v) for h, v in ((0, 0.0), (1, None), (10, 10.0))]
    df = frame(
        spark, rows, "machine_pk int, timestamp timestamp_ntz, segment int, during_maintenance boolean, s double"
    )
    assert by(interpolate(context_chunks(df, ONE), ONE), "us")[1]["s"] == 5.0
    assert by(interpolate(context_chunks(df, ONE), ONE, by="time"), "us")[1]["s"] == 1.0


@pytest.mark.parametrize("parts", [1, 6])
def test_rolling_against_brute_force_over_chunk_limits(spark, parts):
    rng = random.Random(5)
    rows = []
    for m, n in ((1, 120), (2, 15)):
        for t in sorted(rng.sample(range(0, 400), n)):
            rows.append((m, t * HOUR_US // 2, t // 150, False, rng.choice([None, rng.uniform(0, 9)]), t))
    df = spark.createDataFrame(
        rows, "machine_pk int, us long, segment int, during_maintenance boolean, s double, pieces_produced int"
    )
    made = segment_frame(context_chunks(df, ONE, parts), ONE)
    got = {
        (r["machine_pk"], r["us"]): r
        for r in features(made, ONE, rolling_stats(ONE)).collect()
    }
    assert len(got) == len(rows)
    for m, us, seg, _, _, _ in rows:
        past = [r for r in rows if r[0] == m and r[2] == seg and r[1] <= us]
        for h in WINDOWS_H:
            seen = [r[4] for r in past if r[1] > us - h * HOUR_US and r[4] is not None]
            r = got[(m, us)]
            assert r[f"s_max_{h}h"] == max(seen, default=None)
            if seen:
                assert r[f"s_mean_{h}h"] == pytest.approx(sum(seen) / len(seen))
        assert got[(m, us)]["prod_cumul_segment"] == sum(r[5] for r in past)


# --- splits --------------------------------------------------------------------------------


def test_split_cuts_the_time_span(spark):
    """Shares of the span, not of the rows: a busy end does not move the cuts."""
    hours = [0, 30, 69.9, 70, 84.9, 85, *[90 + k / 10 for k in range(60)], 100]
    df = frame(spark, [(hour(h),) for h in hours], "timestamp timestamp_ntz")
    got = {r["split"]: (r["n"], r["first"]) for r in splits.assign_split(df, "us").groupBy("split").agg(F.count("us").alias("n"), F.min("timestamp").alias("first")).collect()}
    assert got == {"train": (3, hour(0)), "val": (2, hour(70)), "test": (62, hour(85))}


def test_split_label_rates(spark):
    # a label of horizon h is set on every (h / 6)-th row of a part; parts of 16, 8 and 24 rows
    rows = [(part, *[int(i % (h // 6) == 0) for h in HORIZONS_H]) for part, n in (("train", 16), ("val", 8), ("test", 24)) for i in range(n)]
    rows[0] = ("train", 0, *rows[0][2:])
    df = spark.createDataFrame(rows, "split string, " + ", ".join(f"label_incident_{h}h int" for h in HORIZONS_H))
    out = {r["horizon_h"]: (r["train"], r["val"], r["test"]) for r in splits.split_label_rates(df).collect()}
    assert out == {6: (0.9375, 1.0, 1.0), 12: (0.5, 0.5, 0.5), 24: (0.25, 0.25, 0.25), 48: (0.125, 0.125, 0.125)}


def test_split_smd(spark):
    # train 1, 5, 9 and test 4, 8, 12: variances 16, means 3 apart; the second column is the first mirrored; the third stands still
    rows = [(part, float(v), float(-v), 4.0) for part, values in (("train", (1, 5, 9)), ("val", (100,)), ("test", (4, 8, 12))) for v in values]
    out = splits.split_smd(spark.createDataFrame(rows, "split string, up double, down double, still double"), ["still", "up", "down"]).collect()
    assert [(r["feature"], r["smd_train_test"]) for r in out] == [("down", -0.75), ("up", 0.75), ("still", 0.0)]
    assert [(r["train_mean"], r["val_mean"], r["test_mean"]) for r in out] == [(-5.0, -100.0, -8.0), (5.0, 100.0, 8.0), (4.0, 4.0, 4.0)]


def test_split_shares(spark):
    rows = [("train", "oak")] * 3 + [("train", "ash")] * 5 + [("test", "elm")] * 2 + [("test", "oak")] * 6 + [("val", "ash")]
    out = {r["level"]: r for r in splits.split_shares(spark.createDataFrame(rows, "split string, wood string"), ["wood"]).collect()}
    assert {k: (r["train"], r["val"], r["test"]) for k, r in out.items()} == {"oak": (0.375, 0.0, 0.75), "ash": (0.625, 1.0, 0.0), "elm": (0.0, 0.0, 0.25)}


def test_folds_are_chronological_and_order_free(spark, chunks):
    stamps = [(i, hour(i)) for i in range(24)]
    shuffled = random.Random(1).sample(stamps, len(stamps))
    outs = []
    for rows in (stamps, shuffled):
        df = frame(spark, rows, "id int, timestamp timestamp_ntz")
        outs.append(by(splits.fold_bounds(df, "us", ["id"], 3), "fold"))
    assert outs[0] == outs[1]
    assert [(r["n_train"], r["n_val"]) for r in outs[0]] == [(6, 6), (12, 6), (18, 6)]
    assert all(r["train_max_us"] < r["val_min_us"] for r in outs[0])


def test_fold_smd_zero_for_constant(spark):
    rows = [(i, i * HOUR_US, i % 2, 1.0, float(i)) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, us long, y int, flat double, ramp double")
    out = by(splits.fold_smd(df, "us", ["id"], "y", ["flat", "ramp"], 3), "fold")
    assert all(r["smd_max_feature"] == "ramp" and r["smd_abs_max"] > 1 for r in out)
    assert all(r["n_features_smd_notable"] == 1 for r in out)
    flat = by(splits.fold_smd(df, "us", ["id"], "y", ["flat"], 3), "fold")
    assert all(r["smd_abs_max"] == 0.0 for r in flat)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 40_000])
def test_quantiles_match_linear_interpolation(spark, chunks, n):
    rng = random.Random(n)
    values = [float(rng.choice([rng.randrange(5), rng.gauss(0, 100)])) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 3.0)] * 3, "k string, v double")
    probs = {"q1": 0.25, "mid": 0.5, "q3": 0.75, "top": 1.0}
    got = {r["k"]: r for r in quantiles(df, ["k"], "v", probs).collect()}
    ordered = sorted(values)
    for name, p in probs.items():
        pos = p * (n - 1)
        lo = int(pos)
        hi = min(lo + 1, n - 1)
        want = ordered[lo] + (pos - lo) * (ordered[hi] - ordered[lo])
        assert got["a"][name] == pytest.approx(want)
        assert got["b"][name] == 3.0
    assert got["a"]["n"] == n


def test_chunks_follow_the_input(spark, monkeypatch, tmp_path):
    """More chunks than shuffle partitions where these would be too large; sources of unknown size don't count."""
    from fleetcast.operators import ordered

    spark.range(5000).select("id", (F.col("id") * 7919 % 5003).alias("k")).repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    size = ordered.input_bytes(df)
    assert 5000 < size < 10**6 and ordered.input_bytes(df.join(df.withColumnRenamed("id", "j"), "k")) == 2 * size
    assert ordered.input_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) == 0
    assert ordered._chunk_count(df) is None
    monkeypatch.setattr(ordered, "CHUNK_BYTES", size * ordered.EXPANSION // 9)
    chunked = ordered.order_chunks(df, ["k"])
    assert 9 <= chunked.select(ordered.CHUNK).distinct().count() <= 10
    assert [r.k for r in ordered.with_index(chunked).orderBy(ordered.IDX).collect()] == sorted(i * 7919 % 5003 for i in range(5000))


def test_dates_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    df = frame(spark, [(dt.datetime(1970, 1, 1, 1),)], "timestamp timestamp_ntz")
    assert df.first()["us"] == HOUR_US

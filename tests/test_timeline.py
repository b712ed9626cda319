"""Event time line: labels, remaining life, as-of lookups, membership, segments."""

from __future__ import annotations

import random

import pytest

from fleetcast.operators.timeline import add_history, add_labels, event_context
from fleetcast.roles import DAY_US, HOUR_US
from tests.helpers import by, frame, hour

TS = "machine_pk int, timestamp timestamp_ntz"


def incidents_of(spark, *hours, machine=1):
    return frame(spark, [(machine, hour(h)) for h in hours], TS).select("machine_pk", "us")


def maintenance_of(spark, *spans, machine=1):
    rows = [(machine, hour(s)) for s, _ in spans]
    df = frame(spark, rows, TS)
    ends = {int(hour(s).timestamp()): d for s, d in spans}
    out = [
        (r["machine_pk"], r["us"], r["us"] + int(d * HOUR_US))
        for r, (_, d) in zip(df.orderBy("us").collect(), sorted(spans))
    ]
    assert len(ends) == len(out)
    return spark.createDataFrame(out, "machine_pk int, us long, end_us long")


def empty_events(spark):
    return spark.createDataFrame([], "machine_pk int, us long")


def empty_maintenance(spark):
    return spark.createDataFrame([], "machine_pk int, us long, end_us long")


def test_labels_and_remaining_life(spark, chunks):
    """Two incidents, 20 and 50 hours on; readings at uneven times, the last of them after both."""
    at = [0, 1.5, 9, 13.75, 19.5, 20, 26, 49, 50, 53.25]
    ctx = event_context(frame(spark, [(4, hour(h)) for h in at], TS), incidents_of(spark, 20, 50, machine=4), empty_maintenance(spark), "machine_pk")
    rows = by(add_labels(ctx), "us")
    nearest = [min((u - h for u in (20, 50) if u > h), default=None) for h in at]
    assert [r["rul_hours"] for r in rows] == nearest and [r["rul_censored"] for r in rows] == [int(n is None) for n in nearest]
    for horizon in (6, 12, 24, 48):
        assert [r[f"label_incident_{horizon}h"] for r in rows] == [int(n is not None and n <= horizon) for n in nearest]


def test_label_interval_is_left_open_right_closed(spark):
    readings = frame(spark, [(1, hour(0)), (1, hour(1)), (1, hour(7))], TS)
    ctx = event_context(readings, incidents_of(spark, 7), empty_maintenance(spark), "machine_pk")
    rows = by(add_labels(ctx), "us")
    assert [r["label_incident_6h"] for r in rows] == [0, 1, 0]


def test_time_since_maintenance_counts_from_its_end(spark):
    """Works of 30 hours and of 45 minutes: zero while they last, then the hours since."""
    at = {5: None, 10: 0.0, 27.5: 0.0, 40: 0.0, 41: 1.0, 63: 23.0, 64: 0.0, 66: 1.25}
    readings = frame(spark, [(2, hour(h)) for h in at], TS)
    ctx = event_context(readings, empty_events(spark), maintenance_of(spark, (10, 30), (64, 0.75), machine=2), "machine_pk")
    rows = by(add_history(ctx), "us")
    assert [r["time_since_last_maintenance_h"] for r in rows] == list(at.values())
    assert {r["time_since_last_incident_h"] for r in rows} == {None}


def test_membership_and_segments(spark, chunks):
    """Back-to-back works: the second begins a segment although the first has just ended."""
    works = [(8, 4), (12, 1), (30, 6)]
    at = [0, 7.99, 8, 11.5, 12, 12.99, 13, 29, 30, 35.99, 36, 80]
    readings = frame(spark, [(9, hour(h)) for h in at], TS)
    rows = by(event_context(readings, empty_events(spark), maintenance_of(spark, *works, machine=9), "machine_pk"), "us")
    assert [r["segment"] for r in rows] == [0, 0, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3]
    assert [r["during_maintenance"] for r in rows] == [any(a <= h < a + d for a, d in works) for h in at]


def test_events_of_unknown_machines_are_ignored(spark):
    readings = frame(spark, [(1, hour(0))], TS)
    lost = spark.createDataFrame([(None, 5)], "machine_pk int, us long")
    row = event_context(readings, lost, empty_maintenance(spark), "machine_pk").first()
    assert row["next_incident_us"] is None and row["n_incidents_7d"] == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_against_brute_force_with_a_hot_machine(spark, parts):
    rng = random.Random(3)
    # machine 1 holds most rows; equal instants occur among readings and events
    machines = [1] * 8 + [2, 3]
    pick = lambda: (rng.choice(machines), rng.randrange(0, 60 * 24) * HOUR_US)
    readings = sorted({pick() for _ in range(300)})
    incidents = [pick() for _ in range(60)]
    works = [(*pick(), rng.randrange(1, 30)) for _ in range(40)]
    ctx = event_context(
        spark.createDataFrame(readings, "machine_pk int, us long").repartition(3),
        spark.createDataFrame(incidents, "machine_pk int, us long"),
        spark.createDataFrame(
            [(m, t, t + d * HOUR_US) for m, t, d in works], "machine_pk int, us long, end_us long"
        ),
        "machine_pk",
        parts,
    )
    got = {(r["machine_pk"], r["us"]): r for r in ctx.collect()}
    assert len(got) == len(readings)
    for m, t in readings:
        r = got[(m, t)]
        mine = [u for k, u in incidents if k == m]
        spans = [(u, u + d * HOUR_US) for k, u, d in works if k == m]
        assert r["segment"] == sum(s <= t for s, _ in spans)
        assert r["during_maintenance"] == any(s <= t < e for s, e in spans)
        last = max([(s, e) for s, e in spans if s <= t], default=(None, None))
        assert (r["last_start_us"], r["last_end_us"]) == last
        assert r["last_incident_us"] == max([u for u in mine if u < t], default=None)
        assert r["next_incident_us"] == min([u for u in mine if u > t], default=None)
        assert r["n_incidents_7d"] == sum(t - 7 * DAY_US <= u < t for u in mine)
        assert r["n_incidents_30d"] == sum(t - 30 * DAY_US <= u < t for u in mine)
        assert r["n_maintenance_30d"] == sum(t - 30 * DAY_US <= s < t for s, _ in spans)

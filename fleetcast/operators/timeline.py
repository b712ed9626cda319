"""Readings in the context of point events (incidents) and intervals (maintenance).

Range joins between readings and events would pair every reading with every event of its
entity. Here both sides go on one time line per entity, ordered once in chunks
(:mod:`fleetcast.operators.ordered`), and every lookup is a running aggregate over it:
linear in rows, with hot entities split over many chunks.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.operators.ordered import CHUNK, carry_over, chunk_window, join_carry, order_chunks
from fleetcast.roles import DAY_US, HORIZONS_H, HOUR_US, Roles
from fleetcast.session import stage

# Columns added by event_context, all in microseconds or counts.
CONTEXT = (
    "segment",
    "during_maintenance",
    "last_start_us",
    "last_end_us",
    "last_incident_us",
    "next_incident_us",
    "n_incidents_7d",
    "n_incidents_30d",
    "n_maintenance_30d",
)

_INCIDENT_DAYS = (7, 30)
_MAINTENANCE_DAYS = 30
_MARKS = ("has_inc", "n_start", "d_inc7", "d_inc30", "d_mnt30")


#: what each lookup needs of the events: marks, and the carries of earlier chunks
_OF_INCIDENTS = ("last_incident_us", "next_incident_us", "n_incidents_7d", "n_incidents_30d")
_OF_MAINTENANCE = tuple(c for c in CONTEXT if c not in _OF_INCIDENTS)


def _event_rows(incidents: DataFrame, maintenance: DataFrame, entity: str, wanted: Collection[str]) -> DataFrame:
    """One row per (entity, instant) with event marks and count changes; only what ``wanted`` lookups need.

    An event adds one to its past counts at its own time and takes it back one look-back
    later, so a sliding count becomes a running total.
    """
    inc = incidents.filter(F.col(entity).isNotNull() & F.col("us").isNotNull())
    mnt = maintenance.filter(F.col(entity).isNotNull() & F.col("us").isNotNull())
    no_end = F.lit(None).cast("long")

    def mark(at, end=no_end, **given):
        cols = [F.lit(given.get(c, 0)).cast("long").alias(c) for c in _MARKS]
        return F.struct(at.alias("us"), end.alias("end_us"), *cols)

    us = F.col("us")
    d7, d30 = (d * DAY_US for d in _INCIDENT_DAYS)
    inc_marks = [mark(us, has_inc=1, d_inc7=1, d_inc30=1)]
    if "n_incidents_7d" in wanted:
        inc_marks.append(mark(us + d7, d_inc7=-1))
    if "n_incidents_30d" in wanted:
        inc_marks.append(mark(us + d30, d_inc30=-1))
    mnt_marks = [mark(us, F.col("end_us"), n_start=1, d_mnt30=1)]
    if "n_maintenance_30d" in wanted:
        mnt_marks.append(mark(us + _MAINTENANCE_DAYS * DAY_US, d_mnt30=-1))
    rows = []
    if any(c in wanted for c in _OF_INCIDENTS):
        rows.append(inc.select(entity, F.inline(F.array(*inc_marks))))
    if any(c in wanted for c in _OF_MAINTENANCE):
        rows.append(mnt.select(entity, F.inline(F.array(*mnt_marks))))
    return reduce(DataFrame.unionByName, rows).groupBy(entity, "us").agg(
        F.max("end_us").alias("end_us"),
        F.max("has_inc").alias("has_inc"),
        *[F.sum(c).alias(c) for c in _MARKS if c != "has_inc"],
    )


def event_context(
    readings: DataFrame,
    incidents: DataFrame,
    maintenance: DataFrame,
    entity: str,
    parts: int | None = None,
    *,
    wanted: Collection[str] = CONTEXT,
    keep_chunks: bool = False,
) -> DataFrame:
    """Add to every reading its maintenance segment, interval membership and nearest events.

    ``readings`` has ``entity`` and ``us``; ``incidents`` the same; ``maintenance`` has
    ``entity``, ``us`` (start) and ``end_us``. Edges: segment counts starts <= t; membership
    is [start, end); last maintenance is the last one started <= t; last incident is < t and
    next incident > t; counts cover [t - H, t). Only the ``wanted`` lookups are built, from the events they
    need. ``keep_chunks`` keeps the order chunks for operators that go on with the same order.
    """
    if not wanted or not set(wanted) <= set(CONTEXT):
        raise ValueError(f"wanted are some of {', '.join(CONTEXT)}")
    payload = [c for c in readings.columns if c not in (entity, "us")]
    events = _event_rows(incidents, maintenance, entity, wanted)
    line = readings.withColumn("_reading", F.lit(True)).unionByName(
        events, allowMissingColumns=True
    )
    chunked = order_chunks(line, [entity, "us"], parts)

    asc = chunk_window([entity], "us")
    upto = asc.rangeBetween(Window.unboundedPreceding, 0)
    past = asc.rangeBetween(Window.unboundedPreceding, -1)
    # a descending order keeps the growing frame linear; unboundedFollowing would not
    future = chunk_window([entity], F.col("us").desc()).rangeBetween(Window.unboundedPreceding, -1)
    started = F.when(F.col("n_start") > 0, F.struct("us", "end_us"))
    inc_us = F.when(F.col("has_inc") > 0, F.col("us"))

    def running(col: str, carry: str, frame):
        return F.coalesce(F.col(carry), F.lit(0)) + F.coalesce(F.sum(col).over(frame), F.lit(0))

    last = F.coalesce(F.max(started).over(upto), F.col("c_last"))
    seen_end = F.greatest(F.max("end_us").over(upto), F.col("c_end"))
    # lookup -> what is carried into a chunk from the ones before it, and the lookup itself
    built = {
        "segment": ("c_start", F.sum("n_start"), F.sum, running("n_start", "c_start", upto)),
        "during_maintenance": ("c_end", F.max("end_us"), F.max, F.coalesce(seen_end > F.col("us"), F.lit(False))),
        "last_start_us": ("c_last", F.max(started), F.max, last["us"]),
        "last_end_us": ("c_last", F.max(started), F.max, last["end_us"]),
        "last_incident_us": ("c_inc", F.max(inc_us), F.max, F.coalesce(F.max(inc_us).over(past), F.col("c_inc"))),
        "n_incidents_7d": ("c_inc7", F.sum("d_inc7"), F.sum, running("d_inc7", "c_inc7", past)),
        "n_incidents_30d": ("c_inc30", F.sum("d_inc30"), F.sum, running("d_inc30", "c_inc30", past)),
        "n_maintenance_30d": ("c_mnt30", F.sum("d_mnt30"), F.sum, running("d_mnt30", "c_mnt30", past)),
    }
    names = [c for c in CONTEXT if c in wanted]
    forward = {built[c][0]: built[c][1:3] for c in names if c in built}
    line = chunked
    if forward:
        partials, merges = ({n: x[k] for n, x in forward.items()} for k in (0, 1))
        line = join_carry(line, [entity], carry_over(chunked, [entity], partials, merges, lead=entity))
    lookups = {c: built[c][3] for c in names if c in built}
    if "next_incident_us" in names:
        ahead = carry_over(chunked, [entity], {"c_next": F.min(inc_us)}, {"c_next": F.min}, backward=True, lead=entity)
        line = join_carry(line, [entity], ahead)
        lookups["next_incident_us"] = F.coalesce(F.min(inc_us).over(future), F.col("c_next"))
    kept = [CHUNK] if keep_chunks else []
    out = line.select(entity, "us", *payload, *kept, "_reading", *[lookups[c].alias(c) for c in names])
    return out.filter("_reading").drop("_reading")


STEP = "_step"


def context_chunks(context: DataFrame, roles: Roles, parts: int | None = None) -> DataFrame:
    """Stage readings with context in their order chunks, with their place in the chunk.

    Inside a segment the readings under maintenance come first, since no later interval
    starts there; the (entity, time) order therefore also keeps the operational readings
    of a segment together, and the chunks of the time line serve every segment operator.
    ``_step`` counts a segment's readings of one regime inside the chunk.
    """
    if CHUNK not in context.columns:
        context = order_chunks(context, [roles.entity, roles.us], parts)
    keys = [roles.entity, roles.segment, roles.during]
    return stage(context.withColumn(STEP, F.row_number().over(chunk_window(keys, roles.us))))


def with_position(chunks: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Position of a reading in its segment and regime, across chunks."""
    earlier = carry_over(chunks, keys, {"_c_n": F.count(F.lit(1))}, {"_c_n": F.sum}, lead=keys[0])
    return (
        join_carry(chunks, keys, earlier)
        .withColumn(name, F.coalesce(F.col("_c_n"), F.lit(0)) + F.col(STEP))
        .drop("_c_n")
    )


def hours(us_column):
    """Microseconds as hours."""
    return us_column / F.lit(HOUR_US)


def history_columns(known: Collection[str] = CONTEXT) -> dict:
    """Time-since features from the known context columns (NULL when there is no earlier event)."""
    gap = F.col("us") - F.col("last_end_us")
    out = {}
    if "last_end_us" in known:
        # measured from the end of the last started intervention, never negative
        out["time_since_last_maintenance_h"] = F.when(gap.isNotNull(), hours(F.greatest(gap, F.lit(0))))
    if "last_incident_us" in known:
        out["time_since_last_incident_h"] = hours(F.col("us") - F.col("last_incident_us"))
    return out


def label_columns(horizons: Sequence[int] = HORIZONS_H) -> dict:
    """Event in (t, t+H] for each horizon, hours to the next event, and the censoring mark."""
    wait = F.col("next_incident_us") - F.col("us")
    labels = {
        f"label_incident_{h}h": F.coalesce((wait <= h * HOUR_US).cast("int"), F.lit(0))
        for h in horizons
    }
    return {
        **labels,
        "rul_hours": hours(wait),
        "rul_censored": wait.isNull().cast("int"),
    }


def add_history(context: DataFrame) -> DataFrame:
    """Time since the last maintenance and incident (past counts are already in the context)."""
    return context.withColumns(history_columns(context.columns))


def add_labels(context: DataFrame, horizons: Sequence[int] = HORIZONS_H) -> DataFrame:
    """Multi-horizon labels, remaining useful life and its censoring mark."""
    return context.withColumns(label_columns(horizons))

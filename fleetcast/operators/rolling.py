"""Leak-free features: trailing windows inside a maintenance segment.

All windows are keyed by (entity, segment) and bounded by time, so a chunk needs only a
halo of rows from the longest window before its start; running totals use a carry.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetcast.functions.trailing import Stat, trailing_stats
from fleetcast.operators.ordered import (
    CHUNK,
    HALO,
    carry_over,
    chunk_window,
    join_carry,
    with_halo,
)
from fleetcast.operators.timeline import with_position
from fleetcast.roles import HOUR_US, Roles

STATS = ("mean", "std", "min", "max", "slope")


def segment_frame(chunked: DataFrame, roles: Roles, reach_h: int | None = None) -> DataFrame:
    """Operational readings with their halo, the segment start and the production total brought in.

    ``chunked`` holds the operational rows of staged context chunks.
    """
    keys = [roles.entity, roles.segment]
    partials = {"_c_start": F.min(roles.us)}
    merge = {"_c_start": F.min}
    if roles.production in chunked.columns:
        partials["_c_prod"] = F.sum(roles.production)
        merge["_c_prod"] = F.sum
    carry = carry_over(chunked, keys, partials, merge, lead=roles.entity)
    placed = with_halo(chunked, keys, roles.us, (reach_h or max(roles.windows_h)) * HOUR_US)
    return join_carry(placed, keys, carry)


def _keys(roles: Roles) -> list[str]:
    return [roles.entity, roles.segment]


def segment_start(roles: Roles) -> Column:
    """First instant of the segment."""
    here = F.min(roles.us).over(Window.partitionBy(*_keys(roles), CHUNK))
    return F.least(here, F.col("_c_start"))


def rolling_stats(roles: Roles, stats: Sequence[str] = STATS) -> list[Stat]:
    """Mean, std, min, max and least-squares slope (units per hour) per sensor and window.

    Windows are (t - w, t]. The slope is 0 with one instant and missing without any value.
    """
    return [
        Stat(f"{s}_{stat}_{h}h", s, stat, h)
        for h in roles.windows_h
        for s in roles.sensors
        for stat in stats
    ]


_MARKS = (("imputed", "was_imputed"), ("outlier", "is_outlier"), ("saturated", "is_saturated"))


def mark_columns(roles: Roles) -> dict[str, Column]:
    """Imputed, outlier and saturated marks of a reading, summed over its sensors."""
    return {
        f"_n_{name}": reduce(
            lambda a, b: a + b,
            [F.coalesce(F.col(f"{s}_{mark}").cast("long"), F.lit(0)) for s in roles.sensors],
        )
        for name, mark in _MARKS
    }


def quality_stats(roles: Roles) -> list[Stat]:
    """Marks summed over each window."""
    return [
        Stat(f"n_{name}_{h}h", f"_n_{name}", "sum", h) for name, _ in _MARKS for h in roles.windows_h
    ]


def production_stats(roles: Roles) -> list[Stat]:
    """Production sum and mean of the last 24 h."""
    return [
        Stat("prod_sum_24h", roles.production, "sum", 24),
        Stat("prod_mean_24h", roles.production, "mean", 24),
    ]


def production_total(roles: Roles) -> Column:
    """Production since the segment start; missing where the reading has none."""
    made = F.col(roles.production)
    upto = chunk_window(_keys(roles), roles.us).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(~F.col(HALO), made)
    total = F.coalesce(F.col("_c_prod"), F.lit(0)) + F.sum(own).over(upto)
    return F.when(made.isNotNull(), total)


def apply_windows(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Evaluate window expressions on a segment frame and drop the halo copies."""
    kept = [c for c in frame.columns if not c.startswith("_")]
    made = frame.select(*kept, HALO, *[c.alias(n) for n, c in columns.items()])
    return made.filter(~F.col(HALO)).drop(HALO)


def apply_trailing(
    frame: DataFrame,
    roles: Roles,
    stats: Sequence[Stat],
    columns: dict[str, Column] | None = None,
) -> DataFrame:
    """Add trailing-window statistics (and window expressions) to a segment frame.

    Rows move once, by (segment, chunk), and are sorted once: the expression windows ask for
    that order and the Arrow kernel runs on what they leave.
    """
    kept = [c for c in frame.columns if not c.startswith("_")]
    extra = dict(columns or {})
    helpers = mark_columns(roles) if any(s.column.startswith("_n_") for s in stats) else {}
    order = chunk_window(_keys(roles), roles.us)
    inputs = sorted({s.column for s in stats} - set(kept) - set(helpers))
    if inputs:
        raise ValueError(f"missing columns {inputs}")
    ready = frame.withColumns(helpers).select(
        *kept,
        *helpers,
        *[c.alias(n) for n, c in extra.items()],
        HALO,
        CHUNK,
        (F.row_number().over(order) == 1).alias("_start"),
    ).sortWithinPartitions(*_keys(roles), CHUNK, roles.us)
    keep = [*kept, *extra]
    whole = {f.name for f in ready.schema if isinstance(f.dataType, T.IntegralType)}
    schema = T.StructType(
        [
            *[ready.schema[c] for c in keep],
            *[
                T.StructField(s.name, T.LongType() if s.stat == "sum" and s.column in whole else T.DoubleType())
                for s in stats
            ],
        ]
    )
    kernel = trailing_stats(list(stats), roles.us, "_start", HALO, keep, whole)
    return ready.mapInArrow(kernel, schema)


def hours_in_segment(frame: DataFrame, roles: Roles) -> DataFrame:
    """Hours since the first operational reading of the segment."""
    return apply_windows(
        frame, {"hours_in_segment": (F.col(roles.us) - segment_start(roles)) / HOUR_US}
    )


def lag_features(
    chunked: DataFrame, roles: Roles, lags: Sequence[int] = (1, 3, 6)
) -> DataFrame:
    """Sensor values 1, 3, 6 operational readings earlier in the same segment."""
    keys = _keys(roles)
    placed = with_position(chunked, keys, "place")
    frame = with_halo(placed, keys, "place", max(lags) + 1)
    w = chunk_window(keys, "place")
    return apply_windows(
        frame,
        {f"{s}_lag_{k}": F.lag(s, k).over(w) for s in roles.sensors for k in lags},
    ).drop("place")

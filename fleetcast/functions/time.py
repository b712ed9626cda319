"""Time expressions: naive-UTC conformance, shifts, calendar axes, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def naive_utc(col: Column | str) -> Column:
    """Any date, zoned or naive time as a naive timestamp read as UTC (session zone is UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("timestamp").cast("timestamp_ntz")


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch, the numeric order key of every time line."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def shift_of_hour(hour: Column) -> Column:
    """Team on duty: matin 06-14, apres-midi 14-22, nuit otherwise."""
    return (
        F.when((hour >= 6) & (hour < 14), "matin")
        .when((hour >= 14) & (hour < 22), "apres-midi")
        .when(hour.isNotNull(), "nuit")
    )


def time_axes(ts: str) -> dict[str, Column]:
    """Day, hour, weekday name and shift of a timestamp column."""
    hour = F.hour(ts)
    return {
        "jour": F.to_date(ts),
        "heure": hour,
        "weekday": F.date_format(ts, "EEEE"),
        "shift": shift_of_hour(hour),
    }


def iso_week(ts: Column) -> Column:
    """ISO year and week as ``YYYY-Sww``."""
    return F.format_string(
        "%04d-S%02d", F.date_part(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts)
    )


def date_and_clock(date: Column, clock: Column) -> Column:
    """Join a date and an ``HH:MM`` text; NULL when either is missing or unreadable."""
    text = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" "), clock)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def cyclic(ts: str) -> dict[str, Column]:
    """Sine and cosine of hour of day and of day of week (Monday is 0)."""
    hour = F.hour(ts) * F.lit(2 * math.pi / 24)
    dow = F.weekday(F.col(ts)) * F.lit(2 * math.pi / 7)
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "dow_sin": F.sin(dow),
        "dow_cos": F.cos(dow),
    }

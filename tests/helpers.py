"""Small builders for test frames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fleetcast.functions.time import micros

START = dt.datetime(2025, 1, 1)


def hour(h: float, start: dt.datetime = START) -> dt.datetime:
    return start + dt.timedelta(hours=h)


def frame(spark, rows, schema):
    """Frame with an ``us`` column next to a ``timestamp`` column, if there is one."""
    df = spark.createDataFrame(rows, schema)
    if "timestamp" in df.columns:
        df = df.withColumn("us", micros("timestamp"))
    return df


def by(df, *keys):
    """Rows as dicts, sorted by keys."""
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(r[k] for k in keys))


def lit_col(df, **cols):
    return df.withColumns({k: F.lit(v) for k, v in cols.items()})

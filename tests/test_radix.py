"""Quantiles by radix selection against sorted values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetcast.operators import radix
from fleetcast.operators.radix import codes_of, column_quantiles, value_of

PROBS = {"least": 0.0, "q1": 0.25, "mid": 0.5, "odd": 0.317, "q3": 0.75, "top": 1.0}


def interpolated(values, p):
    values = sorted(values)
    place = p * (len(values) - 1)
    lo, hi = values[math.floor(place)], values[math.ceil(place)]
    return lo if lo == hi else lo + (place - math.floor(place)) * (hi - lo)


def test_codes_keep_the_order():
    values = np.array([-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 7e88, math.inf, math.nan])
    codes = codes_of(values)
    assert (codes[1:] > codes[:-1]).all()
    assert [value_of(int(c)) for c in codes[:-1]] == values[:-1].tolist() and math.isnan(value_of(int(codes[-1])))


@pytest.fixture
def passes(monkeypatch):
    seen, count = [], radix._counts
    monkeypatch.setattr(radix, "_counts", lambda df, cols, level, wanted: seen.append(level) or count(df, cols, level, wanted))
    return seen


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_quantiles_of_many_columns(spark, passes, n):
    rng = random.Random(n)
    rows = [
        (
            rng.gauss(0, 1e6), rng.choice([None, -3.25, 0.0, 8.5]), rng.randrange(5), None, 1.0 + rng.randrange(1 << 20) * 2.0**-52,
            rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        )
        for _ in range(n)
    ]
    names = ["wide", "few", "whole", "none", "near", "huge"]
    df = spark.createDataFrame(rows, "wide double, few double, whole int, none double, near double, huge double").repartition(3)
    got = column_quantiles(df, names, PROBS)
    for k, c in enumerate(names):
        known = [float(r[k]) for r in rows if r[k] is not None]
        assert got[c]["n"] == len(known)
        for name, p in PROBS.items():
            assert got[c][name] == (interpolated(known, p) if known else None)
    assert len(passes) <= 4


def test_few_passes_where_values_repeat(spark, passes):
    """A third of the rows in one value, prices to the cent: two passes."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 12.5).otherwise((F.col("id") % 977) / 100).alias("v"))
    values = [12.5 if i % 3 == 0 else (i % 977) / 100 for i in range(30_000)]
    got = column_quantiles(df, ["v"], PROBS)["v"]
    assert all(got[name] == pytest.approx(interpolated(values, p), abs=1e-12) for name, p in PROBS.items())
    assert passes == [0, 1] and column_quantiles(df, [], PROBS) == {}


def test_partial_counts_are_merged(spark):
    """More batches than are held at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("v")).coalesce(1)
        assert column_quantiles(df, ["v"], {"mid": 0.5})["v"]["mid"] == interpolated([i * 7919 % 3001 for i in range(3000)], 0.5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

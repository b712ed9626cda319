"""Cleaning and sensor checks: key dedup, interpolation, outliers, saturation, units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.operators.ordered import carry_over, chunk_window, join_carry
from fleetcast.operators.radix import column_quantiles
from fleetcast.operators.reshape import long_rows
from fleetcast.operators.stats import null_cells
from fleetcast.operators.timeline import with_position
from fleetcast.roles import (
    IQR_FACTOR,
    SATURATION_MIN_HITS,
    SATURATION_RATIO,
    UNIT_AMPLITUDE_MAX,
    Roles,
)


def dedup_first(df: DataFrame, keys: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Keep per key the first row in the order of ``ties``.

    A grouped minimum of the whole row, so copies of a hot key merge before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys and c not in ties]
    row = F.struct(*ties, *rest)
    kept = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def interpolate(chunks: DataFrame, roles: Roles, *, by: str = "position") -> DataFrame:
    """Fill missing sensor values linearly inside a segment, outside maintenance.

    ``chunks`` comes from :func:`~fleetcast.operators.timeline.context_chunks`. Steps count
    operational readings (``by="position"``) or elapsed time (``by="time"``); both edges
    take the nearest value; a segment without any value stays missing, and so do readings
    during maintenance. ``<sensor>_was_imputed`` marks what was filled.
    """
    keys = [roles.entity, roles.segment, roles.during]
    x = {"position": "_x", "time": roles.us}[by]
    chunked = with_position(chunks, keys, x) if by == "position" else chunks

    def known(s: str) -> Column:
        usable = F.col(s).isNotNull() & ~F.col(roles.during)
        return F.when(usable, F.struct(F.col(x).alias("x"), F.col(s).alias("y")))

    before = carry_over(
        chunked,
        keys,
        {f"_p_{s}": F.max(known(s)) for s in roles.sensors},
        {f"_p_{s}": F.max for s in roles.sensors},
        lead=roles.entity,
    )
    after = carry_over(
        chunked,
        keys,
        {f"_n_{s}": F.min(known(s)) for s in roles.sensors},
        {f"_n_{s}": F.min for s in roles.sensors},
        backward=True,
        lead=roles.entity,
    )
    line = join_carry(join_carry(chunked, keys, before), keys, after)
    asc = chunk_window(keys, roles.us).rowsBetween(Window.unboundedPreceding, 0)
    desc = chunk_window(keys, F.col(roles.us).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = line.withColumns(
        {
            **{
                f"_p_{s}": F.coalesce(F.last(known(s), True).over(asc), F.col(f"_p_{s}"))
                for s in roles.sensors
            },
            **{
                f"_n_{s}": F.coalesce(F.last(known(s), True).over(desc), F.col(f"_n_{s}"))
                for s in roles.sensors
            },
        }
    )

    def filled(s: str) -> Column:
        p, n = F.col(f"_p_{s}"), F.col(f"_n_{s}")
        share = (F.col(x) - p["x"]) / (n["x"] - p["x"])
        guess = F.when(
            p.isNotNull() & n.isNotNull(), p["y"] + (n["y"] - p["y"]) * share
        ).otherwise(F.coalesce(p["y"], n["y"]))
        return F.when(F.col(s).isNotNull() | F.col(roles.during), F.col(s)).otherwise(guess)

    values = {s: filled(s) for s in roles.sensors}
    marks = {
        f"{s}_was_imputed": F.col(s).isNull() & filled(s).isNotNull() for s in roles.sensors
    }
    plain = [c for c in chunks.columns if c not in roles.sensors]
    return near.select(
        *plain,
        *[c.alias(n) for n, c in values.items()],
        *[c.alias(n) for n, c in marks.items()],
    ).select(*chunks.columns, *marks)


def impute_constant(
    df: DataFrame,
    cols: Sequence[str],
    strategy: str = "median",
    fit: Column | None = None,
) -> DataFrame:
    """Fill missing values with one mean or median per column, fitted on the ``fit`` rows."""
    fitted = fit_constants(df if fit is None else df.filter(fit), cols, strategy)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(fitted[c])) for c in cols})


def fit_constants(df: DataFrame, cols: Sequence[str], strategy: str = "median") -> dict:
    """Mean or exact median of each column (one value per column reaches the driver)."""
    if strategy == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy != "median":
        raise ValueError(f"unknown strategy {strategy!r}, expected 'median' or 'mean'")
    return {c: q["mid"] for c, q in column_quantiles(df, cols, {"mid": 0.5}).items()}


def _bounds(df: DataFrame, cols: Sequence[str], k: float) -> dict[str, tuple]:
    """Tukey bounds from exact quartiles, as scalars (one pair per column), so that they fold into the flag expressions."""
    out = {}
    for c, q in column_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).items():
        q1, q3 = q["q1"], q["q3"]
        out[c] = (None, None) if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def _outside(c: str, low, high) -> Column:
    return F.coalesce((F.col(c) < F.lit(low)) | (F.col(c) > F.lit(high)), F.lit(False))


def detect_outliers(
    df: DataFrame, cols: Sequence[str], k: float = IQR_FACTOR, fit: Column | None = None
) -> DataFrame:
    """Bounds, number and share (%) of values outside the Tukey bounds, per column."""
    b = _bounds(df if fit is None else df.filter(fit), cols, k)
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(_outside(c, *b[c]).cast("long")).alias(c) for c in cols],
    )
    return long_rows(
        counts,
        {
            c: {
                "low": F.lit(b[c][0]),
                "high": F.lit(b[c][1]),
                "n_outliers": F.coalesce(F.col(c), F.lit(0)),
                "pct": F.try_divide(100.0 * F.coalesce(F.col(c), F.lit(0)), F.col("_n")),
            }
            for c in cols
        },
        "measure",
    )


def flag_outliers(
    df: DataFrame, cols: Sequence[str], k: float = IQR_FACTOR, fit: Column | None = None
) -> DataFrame:
    """``<col>_is_outlier`` against Tukey bounds; values are kept."""
    b = _bounds(df if fit is None else df.filter(fit), cols, k)
    return df.withColumns({f"{c}_is_outlier": _outside(c, *b[c]) for c in cols})


def _saturation_facts(df: DataFrame, cols: Sequence[str], width: Mapping[str, float] | float) -> dict:
    """Edges of each column with hit counts: two one-row aggregates reach the driver."""
    edges = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.min(c).alias(f"{c}_lo") for c in cols],
        *[F.max(c).alias(f"{c}_hi") for c in cols],
    ).first()
    aggs = []
    for c in cols:
        w = width.get(c, 1.0) if isinstance(width, Mapping) else width
        lo, hi = edges[f"{c}_lo"], edges[f"{c}_hi"]
        v = F.col(c)
        tests = {
            "at_hi": v == F.lit(hi),
            "at_lo": v == F.lit(lo),
            "by_hi": (v >= F.lit(hi) - w) & (v < F.lit(hi)),
            "by_lo": (v > F.lit(lo)) & (v <= F.lit(lo) + w),
        }
        aggs += [F.count(F.when(t, 1)).alias(f"{c}_{n}") for n, t in tests.items()]
    hits = df.agg(*aggs).first()
    facts = {"_n": edges["_n"]}
    for c in cols:
        lo, hi = edges[f"{c}_lo"], edges[f"{c}_hi"]
        spread = lo is not None and hi > lo

        def confirmed(at: int, by: int) -> bool:
            return bool(spread and at >= SATURATION_MIN_HITS and at > SATURATION_RATIO * max(by, 1))

        at_lo, at_hi = hits[f"{c}_at_lo"], hits[f"{c}_at_hi"]
        sat_lo, sat_hi = confirmed(at_lo, hits[f"{c}_by_lo"]), confirmed(at_hi, hits[f"{c}_by_hi"])
        facts[c] = {
            "low": lo,
            "saturated_low": sat_lo,
            "high": hi,
            "saturated_high": sat_hi,
            "n_saturated": (at_lo if sat_lo else 0) + (at_hi if sat_hi else 0),
        }
    return facts


def detect_saturation(
    df: DataFrame, cols: Sequence[str], width: Mapping[str, float] | float = 1.0
) -> DataFrame:
    """Columns whose extreme value is hit far more often than the values just inside it."""
    facts = _saturation_facts(df, cols, width)
    n = facts.pop("_n")
    rows = [
        (
            c,
            None if f["low"] is None else float(f["low"]),
            f["saturated_low"],
            None if f["high"] is None else float(f["high"]),
            f["saturated_high"],
            f["n_saturated"],
            100.0 * f["n_saturated"] / n if n else 0.0,
        )
        for c, f in facts.items()
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "measure string, low double, saturated_low boolean, high double, "
        "saturated_high boolean, n_saturated long, pct double",
    )


def flag_saturation(
    df: DataFrame, cols: Sequence[str], width: Mapping[str, float] | float = 1.0
) -> DataFrame:
    """``<col>_is_saturated``: the value sits on an edge confirmed as saturated."""
    facts = _saturation_facts(df, cols, width)
    flags = {}
    for c in cols:
        f = facts[c]
        hit = F.lit(False)
        if f["saturated_low"]:
            hit = hit | (F.col(c) == F.lit(f["low"]))
        if f["saturated_high"]:
            hit = hit | (F.col(c) == F.lit(f["high"]))
        flags[f"{c}_is_saturated"] = F.coalesce(hit, F.lit(False))
    return df.withColumns(flags)


def unit_consistency(
    df: DataFrame, entity: str, cols: Sequence[str], max_ratio: float = UNIT_AMPLITUDE_MAX
) -> DataFrame:
    """Largest over smallest entity mean per column; a large ratio suggests mixed units."""
    means = df.groupBy(entity).agg(*[F.avg(c).alias(c) for c in cols])
    ends = means.agg(
        *[F.min(c).alias(f"{c}_lo") for c in cols], *[F.max(c).alias(f"{c}_hi") for c in cols]
    )

    def facts(c: str) -> dict[str, Column]:
        ratio = F.try_divide(F.col(f"{c}_hi"), F.col(f"{c}_lo"))
        return {
            "min_mean": F.col(f"{c}_lo"),
            "max_mean": F.col(f"{c}_hi"),
            "ratio": ratio,
            "unit_suspect": F.coalesce(ratio > max_ratio, F.lit(False)),
        }

    return long_rows(ends, {c: facts(c) for c in cols}, "measure")


def telemetry_metrics(
    df: DataFrame,
    roles: Roles,
    ts: str,
    n_duplicates: int,
    width: Mapping[str, float] | float = 1.0,
) -> DataFrame:
    """Size, period, missing cells and the outcome of the sensor checks in one row."""
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count_distinct(roles.entity).alias("n_machines"),
        null_cells(df).alias("n_null"),
        F.lit(n_duplicates).cast("long").alias("n_duplicates_removed"),
        F.min(ts).alias("period_start"),
        F.max(ts).alias("period_end"),
    )

    def named(test: Column) -> Column:
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(test, F.col("measure")))))

    # one row per sensor each
    outliers = detect_outliers(df, roles.sensors).agg(F.sum("n_outliers").alias("n_outliers"))
    units = unit_consistency(df, roles.entity, roles.sensors).agg(
        named(F.col("unit_suspect")).alias("unit_suspects")
    )
    saturated = detect_saturation(df, roles.sensors, width).agg(
        F.sum("n_saturated").alias("n_saturated"),
        named(F.col("saturated_low") | F.col("saturated_high")).alias("saturated_sensors"),
    )
    parts = [p.withColumn("_one", F.lit(1)) for p in (base, outliers, units, saturated)]
    return reduce(lambda a, b: a.join(b, "_one"), parts).drop("_one")

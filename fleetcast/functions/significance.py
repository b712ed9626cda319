"""Tail probability of the chi-square distribution, for test statistics (one row per test)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x): regularised upper incomplete gamma by series or continued fraction."""
    if x is None or dof is None or math.isnan(x) or dof <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, z = dof / 2.0, x / 2.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    frac = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        frac *= step
        if abs(step - 1) < _EPS:
            return frac * scale
    raise ArithmeticError(f"tail of chi-square {x} with {dof} degrees of freedom did not converge")


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b) for a, b in zip(x, dof)])


def chi2_p_value(statistic: Column, dof: Column) -> Column:
    """p-value column of a chi-square distributed statistic (meant for result rows)."""
    return _chi2_tail(statistic, dof)

"""Statistical expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_sf_10(q: Column) -> Column:
    """P(chi-squared with 10 degrees of freedom > q), in closed form."""
    h = q / 2
    return F.exp(-h) * (1 + h + h * h / 2 + F.pow(h, F.lit(3)) / 6 + F.pow(h, F.lit(4)) / 24)


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def bic(loglik: float, parameters: int, n: int) -> float:
    return -2 * loglik + parameters * math.log(n)


def aic(loglik: float, parameters: int) -> float:
    return -2 * loglik + 2 * parameters

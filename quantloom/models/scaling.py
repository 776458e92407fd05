"""Finite rows and population-standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))


def finite_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without NULL, NaN or infinity in the columns (NaN is above infinity in Spark)."""
    keep = F.lit(True)
    for c in columns:
        keep = keep & is_finite(c)
    return df.filter(keep)


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one pass (a constant column gets deviation 1)."""
    r = df.agg(*[f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"m_{i}"], r[f"s_{i}"] or 1.0) for i, c in enumerate(columns)}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def scaled(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """The same lazily: the one row of statistics is joined, so no job runs before the result is asked for."""
    stats = (fit_on or df).agg(*[f(c).alias(f"_{n}_{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))
    for i, c in enumerate(columns):
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{i}")) / F.when(F.col(f"_s_{i}") > 0, F.col(f"_s_{i}")).otherwise(1.0))
    return out.drop(*stats.columns)

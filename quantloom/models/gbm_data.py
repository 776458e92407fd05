"""Inputs of the quantile models: scores joined with volatility, forward returns, filtered and scaled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import explore
from ..operators.cv import split_last_day
from .scaling import scaled


def first_per_key(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def join_volatility(scores: DataFrame, processed: DataFrame) -> DataFrame:
    """scores with ewm_std of the first bar of equal ticker and start; nothing to do if they have it."""
    if "ewm_std" in scores.columns:
        return scores
    right = processed.groupBy("ticker", "t").agg(F.min_by("ewm_std", "bar_id").alias("ewm_std"))
    return scores.join(right, ["ticker", "t"], "left")


def with_forward_return(df: DataFrame) -> DataFrame:
    return df.withColumn("forward_return", F.col("label") * F.col("ewm_std"))


def forward_return_stats(df: DataFrame) -> DataFrame:
    r = F.col("forward_return")
    return df.groupBy("label").agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"))


def describe(df: DataFrame, column: str) -> DataFrame:
    return explore.describe(df, [column]).drop("column")


def prepare(df: DataFrame, features: list[str], threshold: float = 0.5, proba: str = "rf_proba_reversion", day: str = "date") -> DataFrame:
    """Rows with a probability of at least the threshold and no NULLs, with split (last day: test) and features
    scaled by the training rows."""
    rows = split_last_day(df.filter(F.col(proba) >= threshold).na.drop(), day)
    return scaled(rows, features, rows.filter("split = 'train'"))

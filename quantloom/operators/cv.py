"""Leave-one-day-out folds with purging and embargo, as a long table of roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import micros
from ..session import written


def lodo_folds(bars: DataFrame, day: str = "date", start: str = "t", end: str = "label_t_end", fallback_end: str = "t_end") -> DataFrame:
    """fold, test_day, val_start, val_end: a row for each day, which are few."""
    days = bars.groupBy(F.col(day).alias("test_day")).agg(F.min(start).alias("val_start"), F.coalesce(F.max(end), F.max(fallback_end)).alias("val_end"))
    return days.withColumn("fold", (F.row_number().over(Window.orderBy("test_day")) - 1).cast("int"))


def fold_roles(bars: DataFrame, embargo_minutes: float = 20, day: str = "date", start: str = "t", end: str = "label_t_end", fallback_end: str = "t_end") -> DataFrame:
    """bars times folds with role val, purged, embargoed or train. The folds' table has a row for each day and
    its bounds come as an array on every row, so there is no join of bars with bars. bars are read twice, so
    they are written once."""
    bars = written(bars, "fold-bars")
    folds = lodo_folds(bars, day, start, end, fallback_end)
    every = folds.agg(F.array_sort(F.collect_list(F.struct("fold", "test_day", "val_start", "val_end"))).alias("_folds"))
    rows = bars.crossJoin(F.broadcast(every)).withColumn("_f", F.explode("_folds")).drop("_folds")
    until = F.coalesce(F.col(end), F.col(fallback_end))
    purged = (F.col(start) <= F.col("_f.val_end")) & (until >= F.col("_f.val_start"))
    span = int(embargo_minutes * 60_000_000)
    embargoed = (F.col(start) > F.col("_f.val_end")) & (micros(start) <= micros(F.col("_f.val_end")) + span)
    role = F.when(F.col(day) == F.col("_f.test_day"), "val").when(F.coalesce(purged, F.lit(False)), "purged").when(F.coalesce(embargoed, F.lit(False)), "embargoed").otherwise("train")
    return rows.withColumn("role", role).select(*bars.columns, F.col("_f.fold").alias("fold"), F.col("_f.test_day").alias("test_day"), F.col("_f.val_start").alias("val_start"), F.col("_f.val_end").alias("val_end"), "role")


def fold_metadata(roles: DataFrame, embargo_minutes: float = 20) -> DataFrame:
    span = int(embargo_minutes * 60)
    count = lambda r: F.count_if(F.col("role") == r)
    out = roles.groupBy("fold", "test_day", "val_start", "val_end").agg(count("train").alias("n_train"), count("val").alias("n_val"), count("purged").alias("n_purged"), count("embargoed").alias("n_embargoed"))
    return out.withColumn("embargo_cutoff", F.timestamp_add("SECOND", F.lit(span), F.col("val_end")))


def validate_folds(roles: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """fold, overlap (rows both trained and validated on), coverage, low_coverage, is_valid."""
    per = roles.groupBy("fold", *key).agg(F.count_if(F.col("role") == "train").alias("_t"), F.count_if(F.col("role") == "val").alias("_v"))
    out = per.groupBy("fold").agg(F.count_if((F.col("_t") > 0) & (F.col("_v") > 0)).alias("overlap"), ((F.sum("_t") + F.sum("_v")) / F.count("*")).alias("coverage"))
    return out.withColumns({"low_coverage": F.col("coverage") < 0.5, "is_valid": F.col("overlap") == 0})


def split_first_days(df: DataFrame, train_days: int = 4, day: str = "date") -> DataFrame:
    """df with split: the first days are train, the next one is test, later ones go. Fewer days raise nothing: they
    give no test rows."""
    days = df.select(day).distinct().withColumn("_no", F.row_number().over(Window.orderBy(day)))
    rows = df.join(days, day).filter(F.col("_no") <= train_days + 1)
    return rows.withColumn("split", F.when(F.col("_no") <= train_days, "train").otherwise("test")).drop("_no")


def split_last_day(df: DataFrame, day: str = "date") -> DataFrame:
    """df with split: the last day is test."""
    last = df.agg(F.max(day).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col(day) == F.col("_last"), "test").otherwise("train")).drop("_last")

"""Running sums and exact percentiles over a global order, without a window that holds all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def running_sums(per: DataFrame, order: str, sums: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """per (one row for each value of by and order) with `cum_` and `all_` of each column of sums: its sum up to and
    with the row in that order, and over all rows, within the by columns.

    Rows are range-partitioned and sorted inside each range; the ranges' totals, a row for each partition and group,
    give what comes before a range. Equal keys must have been aggregated, so no range is hot."""
    key = F.col(order).desc() if descending else F.col(order).asc()
    n = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(per.repartitionByRange(n, *by, key).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_range").alias("_r"), *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums], *[F.sum(f"_t_{c}").over(whole).alias(f"all_{c}") for c in sums])
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    inside = Window.partitionBy("_range", *by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(offsets), on)
    rows = rows.withColumns({f"cum_{c}": F.col(f"_i_{c}") + F.col(f"_o_{c}") for c in sums})
    return rows.select(*per.columns, *[f"cum_{c}" for c in sums], *[f"all_{c}" for c in sums])


def percentiles(df: DataFrame, column: str | Column, qs: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q (array of doubles, in the order of qs): exact percentiles with linear interpolation, as F.percentile gives
    them, from running counts of the distinct values. NULLs don't count; without values there is no row of a group, and
    without groups q is NULL."""
    v = (F.col(column) if isinstance(column, str) else column).cast("double")
    per = df.select(*by, v.alias("_v")).filter("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    rows = running_sums(per, "_v", ("_n",), by)
    at = lambda rank: F.min(F.when(F.col("cum__n") > rank, F.col("_v")))
    found = []
    for i, q in enumerate(qs):
        place = (F.col("all__n") - 1) * float(q)
        found += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
    got = rows.groupBy(*by).agg(*found)
    return got.select(*by, F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}") for i in range(len(qs))]).alias("q"))

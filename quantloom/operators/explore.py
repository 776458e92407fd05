"""Exploratory statistics: samples, counts, correlations, dense resampling, flow and return statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentiles
from ..functions.stats import chi2_sf_10
from ..functions.timefns import floor_to, micros

PART = ("ticker", "date")


def stratified_sample(df: DataFrame, key: str, stratum: str = "ticker", total: int = 750, seed: int = 42) -> DataFrame:
    """The same number of rows of each stratum, total // strata, in the order of a hash."""
    strata = df.agg(F.floor(F.lit(total) / F.countDistinct(stratum)).alias("_most"))
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    w = Window.partitionBy(stratum).orderBy(h, key)
    return df.withColumn("_n", F.row_number().over(w)).crossJoin(F.broadcast(strata)).filter("_n <= _most").drop("_n", "_most")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out.limit(top) if top else out


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, count, mean, std, min, p25, p50, p75, max; percentiles are exact."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("r")).select("r.*")
    out = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    out = out.join(percentiles(long, "v", [0.25, 0.5, 0.75], ("column",)).withColumnRenamed("q", "_p"), "column", "left")
    return out.select("column", "count", "mean", "std", "min", F.col("_p")[0].alias("p25"), F.col("_p")[1].alias("p50"), F.col("_p")[2].alias("p75"), "max")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of each pair; NULL pairs are left out pair by pair. One aggregate for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def resample(trades: DataFrame, unit_seconds: int = 1, part: tuple[str, ...] = PART) -> DataFrame:
    """volume, dollar, n_trades of each tumbling interval from the first to the last trade, empty ones included."""
    unit = unit_seconds * 1_000_000
    seen = trades.groupBy(*part, floor_to("ts", unit).alias("slot")).agg(F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("dollar"), F.count("*").alias("n_trades"))
    bounds = seen.groupBy(*part).agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
    step = F.expr(f"interval '{unit_seconds}' second")
    # Hours first, so that no row holds a whole day of slots.
    every = bounds.withColumn("_h", F.explode(F.sequence(floor_to("_a", 3_600_000_000), "_b", F.expr("interval '1' hour"))))
    slots = every.withColumn("slot", F.explode(F.sequence("_h", F.timestamp_add("SECOND", F.lit(3600 - unit_seconds), F.col("_h")), step))).filter("slot between _a and _b").select(*part, "slot")
    return slots.join(seen, [*part, "slot"], "left").na.fill(0, ["volume", "dollar", "n_trades"])


def between_times(df: DataFrame, start: str = "13:35:00", end: str = "19:35:00", on: str = "ts") -> DataFrame:
    """Rows whose UTC time of day is within the bounds, both included."""
    second = F.pmod(micros(on), F.lit(86_400_000_000))
    micro = lambda s: sum(int(x) * f for x, f in zip(s.split(":"), (3600, 60, 1), strict=True)) * 1_000_000
    return df.filter((second >= micro(start)) & (second <= micro(end)))


def flow_stats(slots: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Mean, deviation, CV, Fano factor, zero slots and totals of volume and dollars."""
    def of(c: str) -> list[Column]:
        mean, std, var = F.avg(c), F.stddev_samp(c), F.var_samp(c)
        safe = F.when(mean != 0, mean)
        return [mean.alias(f"{c}_mean"), std.alias(f"{c}_std"), (std / safe).alias(f"{c}_cv"), (var / safe).alias(f"{c}_fano"), F.sum(c).cast("double").alias(f"{c}_total")]

    zero = F.count_if(F.col("volume") == 0)
    return slots.groupBy(*by).agg(F.count("*").alias("slots"), *of("volume"), *of("dollar"), zero.alias("zero_slots"), (100.0 * zero / F.count("*")).alias("zero_pct"))


def intraday_profile(slots: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Mean volume of each minute of day over the days."""
    minute = (F.pmod(micros("slot"), F.lit(86_400_000_000)) / 60_000_000).cast("int")
    return slots.groupBy(*by, minute.alias("minute_of_day")).agg(F.avg("volume").alias("avg_volume"))


def profile_cv(profile: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    mean = F.avg("avg_volume")
    return profile.groupBy(*by).agg(F.count("*").alias("minutes"), (F.stddev_samp("avg_volume") / F.when(mean != 0, mean)).alias("profile_cv"))


def moments(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Population skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurtosis"))


def lag1_autocorrelation(df: DataFrame, column: str, order: tuple[str, ...], part: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_lag", F.lag(column).over(w)).groupBy(*part).agg(F.corr(column, "_lag").alias("autocorr"))


def ljung_box_10(df: DataFrame, column: str, order: tuple[str, ...], part: tuple[str, ...]) -> DataFrame:
    """Q of ten lags about the part's mean and its chi-squared tail; lags, mean and sums share one partitioning."""
    w = Window.partitionBy(*part).orderBy(*order)
    rows = df.filter(F.col(column).isNotNull()).withColumn("_d", F.col(column) - F.avg(column).over(Window.partitionBy(*part)))
    rows = rows.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, 11)})
    sums = rows.groupBy(*part).agg(F.count("*").cast("double").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, 11)])
    n, v = F.col("_n"), F.when(F.col("_v") > 0, F.col("_v"))
    q = n * (n + 2) * reduce(lambda a, b: a + b, [F.pow(F.col(f"_s{k}") / v, F.lit(2)) / (n - k) for k in range(1, 11)])
    return sums.filter("_n > 10").select(*part, q.alias("q")).withColumn("p_value", chi2_sf_10(F.col("q")))


def log_histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """Counts of log10(x + 1) in equal bins from low to high (0 and bins + 1: outside)."""
    return df.groupBy(F.width_bucket(F.log10(F.col(column) + 1), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def scorecard(metrics: DataFrame, name: str = "bar_type", lower_is_better: tuple[str, ...] = (), higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """name, metric, value, score (0 worst to 1 best) and winner for each metric."""
    both = [(c, -1.0) for c in lower_is_better] + [(c, 1.0) for c in higher_is_better]
    long = metrics.select(name, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(s).alias("_sign")) for c, s in both])).alias("r")).select(name, "r.*")
    w = Window.partitionBy("metric")
    good = F.col("value") * F.col("_sign")
    span = F.max(good).over(w) - F.min(good).over(w)
    best = F.row_number().over(w.orderBy(F.desc_nulls_last(good), name)) == 1
    return long.select(name, "metric", "value", F.when(span > 0, (good - F.min(good).over(w)) / span).otherwise(1.0).alias("score"), best.alias("winner"))


def votes(cards: DataFrame, name: str = "bar_type") -> DataFrame:
    return cards.groupBy(name).agg(F.count_if("winner").alias("wins"), F.avg("score").alias("mean_score")).orderBy(F.desc("wins"), name)


def pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """df with the centred projection on the first components, as an array `pca`."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(df)
    centred = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred)
    return out.select(*df.columns, vector_to_array("_p").alias("pca"))


def crosstab_by_column(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts and shares within each column value."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(column)))


def rates_by(df: DataFrame, by: str, flag: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))

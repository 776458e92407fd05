"""Bars that close when an accumulated measure reaches a threshold and then start again from zero."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefns import seconds_between

PART = ("ticker", "date")
ORDER = ("ts", "exch", "price", "size", "cond_norm", "event_id")


def volume_thresholds(ticks: DataFrame, target_bars: int = 600, least: int = 2000, most: int = 100_000, step: int = 100, part: tuple[str, ...] = PART) -> DataFrame:
    """ticker and threshold: the median daily volume over the target count of bars, rounded half-even to a
    multiple of step and clamped."""
    daily = ticks.groupBy(*part).agg(F.sum("size").alias("_volume"))
    rounded = F.bround(F.median("_volume") / target_bars / step) * step
    return daily.groupBy("ticker").agg(F.least(F.greatest(rounded, F.lit(float(least))), F.lit(float(most))).cast("bigint").alias("threshold"))


def segment_by_threshold(df: DataFrame, threshold: str | float, measure: str = "size", order: tuple[str, ...] = ORDER, part: tuple[str, ...] = PART, descending: tuple[str, ...] = ()) -> DataFrame:
    """df with bar_id (from 0 in each part) and bar_closed (on the row that fills its bar). Rows stream through in order, so in Python a part of any
    size needs one batch of memory; in a batch each bar's end is a binary search in the running sums. The accumulated
    measure is the only state that goes from row to row. A NULL threshold (a ticker without one) gives no rows."""
    if not isinstance(threshold, str):
        df, threshold = df.withColumn("_threshold", F.lit(float(threshold))), "_threshold"
    columns = df.columns
    own = df.filter(F.col(threshold).isNotNull()).withColumns({"_m": F.col(measure).cast("double"), "_part": F.struct(*[F.col(c).cast("string") for c in part]), "_t": F.col(threshold).cast("double")})
    # A window, though its number isn't used: it demands whole parts in order. Spark takes out a repartition() above a join by the same
    # columns, and adaptive execution then splits that join's partitions, since nothing seems to need them whole.
    w = Window.partitionBy(*part).orderBy(*[F.col(c).desc() if c in descending else F.col(c) for c in order])
    sorted_rows = own.withColumn("_no", F.row_number().over(w))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in own.schema if f.name not in ('_m', '_part', '_t'))}, bar_id bigint, bar_closed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        here, total, bar = None, 0.0, 0
        for batch in batches:
            n = batch.num_rows
            names = batch.schema.names
            measures = batch.column(names.index("_m")).to_numpy(zero_copy_only=False)
            limits = batch.column(names.index("_t")).to_numpy(zero_copy_only=False)
            parts = batch.column(names.index("_part"))
            keys = np.zeros(n, np.int64)
            for f in parts.flatten():
                codes = f.dictionary_encode().indices.fill_null(-1).to_numpy()
                keys = keys * (codes.max(initial=0) + 2) + codes + 1
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else []
            ids, closed = np.zeros(n, np.int64), np.zeros(n, bool)
            for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                key = parts[int(a)].as_py()
                if key != here:
                    here, total, bar = key, 0.0, 0
                limit = limits[a]
                at = a
                while at < b:
                    # The bar's running sum, begun anew: sums stay as exact as one bar's. What earlier batches gave is its first
                    # summand, so that a sum of doubles doesn't depend on where batches end.
                    size = 64
                    while True:
                        sums = np.cumsum(np.r_[total, measures[at : min(b, at + size)]])[1:]
                        end = int(np.searchsorted(np.maximum.accumulate(sums), limit, side="left"))
                        if end < len(sums) or at + size >= b:
                            break
                        size *= 4
                    ids[at : at + end + 1] = bar
                    if end < len(sums):
                        closed[at + end] = True
                        at, total, bar = at + end + 1, 0.0, bar + 1
                    else:
                        total, at = float(sums[-1]), b
            kept = [batch.column(i) for i, c in enumerate(names) if c not in ("_m", "_part", "_t", "_no")]
            labels = [c for c in names if c not in ("_m", "_part", "_t", "_no")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ids), pa.array(closed)], names=[*labels, "bar_id", "bar_closed"])

    out = sorted_rows.mapInArrow(run, schema)
    return out.drop("_threshold") if "_threshold" in columns else out


def _ordinal(order: tuple[str, ...]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def aggregate_bars(rows: DataFrame, order: tuple[str, ...] = ORDER, part: tuple[str, ...] = PART, *more: Column) -> DataFrame:
    """Open, high, low, close, volume, vwap and trade count of each bar; partial and final hash aggregates."""
    close = F.max_by("price", _ordinal(order))
    return rows.groupBy(*part, "bar_id").agg(
        F.min("ts").alias("t"), F.max("ts").alias("t_end"),
        F.min_by("price", _ordinal(order)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), close.alias("close"),
        F.sum("size").alias("volume"),
        F.when(F.sum("size") > 0, F.sum(F.col("price") * F.col("size")) / F.sum("size")).otherwise(close).alias("vwap"),
        F.count("*").alias("trade_count"),
        *more,
    )


def volume_bars(trades: DataFrame, threshold: str | float, order: tuple[str, ...] = ORDER, part: tuple[str, ...] = PART) -> DataFrame:
    """Bars of each part; a bar takes its last trade whole, and the last partial bar stays."""
    return aggregate_bars(segment_by_threshold(trades, threshold, "size", order, part), order, part)


def generic_bars(trades: DataFrame, measure: str = "dollar", target: int = 3000, order: tuple[str, ...] = ORDER, part: tuple[str, ...] = PART) -> DataFrame:
    """Volume or dollar bars with threshold sum / target; the partial last bar is dropped."""
    rows = trades.withColumn("dollar", F.col("price") * F.col("size"))
    column = "dollar" if measure == "dollar" else "size"
    limits = rows.groupBy(*part).agg((F.sum(column) / target).alias("_limit"))
    cut = segment_by_threshold(rows.join(limits, list(part)), "_limit", column, order, part)
    out = aggregate_bars(cut, order, part, F.sum("dollar").alias("dollar_value"), F.max("bar_closed").alias("_closed"))
    out = out.filter("_closed").drop("_closed").withColumnRenamed("trade_count", "num_trades")
    return out.withColumns({"duration": seconds_between("t", "t_end"), "return": F.ln(F.col("close") / F.col("open"))})


def with_duration(bars: DataFrame) -> DataFrame:
    return bars.withColumn("duration_seconds", seconds_between("t", "t_end"))


def validate_bars(bars: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    """Counts of broken invariants for each part, and is_valid."""
    w = Window.partitionBy(*part).orderBy("bar_id")
    bad = (F.col("high") < F.col("low")) | (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")) | (F.col("low") <= 0)
    out = bars.withColumn("_back", F.coalesce(F.col("t") < F.lag("t").over(w), F.lit(False))).groupBy(*part).agg(
        F.count("*").alias("n_bars"), F.count_if(bad).alias("invalid_ohlc"), F.count_if(F.col("volume") <= 0).alias("invalid_volume"), F.count_if(F.col("trade_count") <= 0).alias("invalid_trade_count"), F.count_if("_back").alias("time_backwards")
    )
    return out.withColumn("is_valid", (F.col("invalid_ohlc") + F.col("invalid_volume") + F.col("invalid_trade_count") + F.col("time_backwards")) == 0)


def bar_statistics(bars: DataFrame, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    return with_duration(bars).groupBy(*by).agg(
        F.count("*").alias("n_bars"), F.avg("volume").alias("mean_volume"), F.median("volume").alias("median_volume"), F.avg("trade_count").alias("mean_trade_count"),
        F.avg("duration_seconds").alias("mean_duration"), F.median("duration_seconds").alias("median_duration"),
    )

"""Best bid and offer: last quotes, capped forward fill, and the as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import share
from ..functions.timefns import micros

PART = ("ticker", "date")
QUOTE_COLUMNS = ("nbb", "nbb_size", "nbo", "nbo_size")


def last_quotes(quotes: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    """A row for each time: the last bid and ask in (exchange, price, size) order; NULL where a side has none.
    Both sides in one aggregate: it is the full outer join of the sides, without a join."""
    def side(kind: str, price: str, size: str) -> list[Column]:
        row = F.max(F.when(F.col("type") == kind, F.struct("exch", F.col("price").alias("p"), F.col("size").alias("s"))))
        return [row["p"].alias(price), row["s"].alias(size)]

    return quotes.groupBy(*part, "ts").agg(*side("BEST_BID", "nbb", "nbb_size"), *side("BEST_ASK", "nbo", "nbo_size"))


def last_quotes_joined(quotes: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    """The same as a full outer equi-join of the sides, each reduced first."""
    def side(kind: str, price: str, size: str) -> DataFrame:
        row = F.max(F.struct("exch", "price", "size"))
        return quotes.filter(F.col("type") == kind).groupBy(*part, "ts").agg(row["price"].alias(price), row["size"].alias(size))

    return side("BEST_BID", "nbb", "nbb_size").join(side("BEST_ASK", "nbo", "nbo_size"), [*part, "ts"], "full_outer")


def ffill_capped(df: DataFrame, columns: tuple[str, ...], cap_seconds: float, part: tuple[str, ...] = PART, on: str = "ts") -> DataFrame:
    """Each column filled with its last value at or before the row unless that is older than the cap."""
    w = Window.partitionBy(*part).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in columns:
        last = F.last(F.when(F.col(c).isNotNull(), F.struct(F.col(on).alias("at"), F.col(c).alias("v"))), ignorenulls=True).over(w)
        out[c] = F.when(micros(on) - micros(last["at"]) <= int(cap_seconds * 1_000_000), last["v"])
    return df.withColumns(out)


def build_nbbo(quotes: DataFrame, cap_seconds: float = 2, part: tuple[str, ...] = PART) -> DataFrame:
    """Complete, uncrossed best bid and offer with mid and spread; locked ones stay."""
    filled = ffill_capped(last_quotes(quotes, part), QUOTE_COLUMNS, cap_seconds, part)
    return filled.na.drop(subset=list(QUOTE_COLUMNS)).filter("nbo >= nbb").withColumns({"mid": 0.5 * (F.col("nbb") + F.col("nbo")), "spread": F.col("nbo") - F.col("nbb")})


def nbbo_stats(quotes: DataFrame, cap_seconds: float = 2, part: tuple[str, ...] = PART) -> DataFrame:
    filled = ffill_capped(last_quotes(quotes, part), QUOTE_COLUMNS, cap_seconds, part)
    complete = F.col("nbb").isNotNull() & F.col("nbo").isNotNull()
    out = filled.groupBy(*part).agg(F.count("*").alias("total_quote_stamps"), F.count_if(complete).alias("complete_stamps"), F.count_if(complete & (F.col("nbo") < F.col("nbb"))).alias("crossed_quotes"))
    return out.withColumn("crossed_quotes_pct", share(F.col("crossed_quotes"), F.col("complete_stamps")))


def asof_backward(left: DataFrame, right: DataFrame, values: tuple[str, ...], by: tuple[str, ...] = PART, on: str = "ts", tolerance_seconds: float | None = None) -> DataFrame:
    """left with the values of the latest right row at or before it (equal times match): a union, one sort by
    key and time, and a running last value. Keys that only one side has need no special case."""
    side = [F.col(c) if c in by or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns]
    both = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(on, *values)).schema[0].dataType).alias("_r")).unionAll(
        right.select(*side, F.lit(0).alias("_side"), F.struct(on, *values).alias("_r"))
    )
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    near = F.lit(True) if tolerance_seconds is None else micros(on) - micros(F.col(f"_r.{on}")) <= int(tolerance_seconds * 1_000_000)
    return out.select(*left.columns, *[F.when(near, F.col(f"_r.{v}")).alias(v) for v in values])


def merge_nbbo(trades: DataFrame, nbbo: DataFrame) -> DataFrame:
    """Trades with the quote that held; trades before any quote go. No tolerance."""
    return asof_backward(trades, nbbo, ("nbb", "nbo", "nbb_size", "nbo_size", "mid", "spread")).filter("mid is not null and spread is not null")


def coverage(trades: DataFrame, nbbo: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    joined = asof_backward(trades, nbbo, ("mid",))
    out = joined.groupBy(*part).agg(F.count("*").alias("before"), F.count("mid").alias("after"))
    return out.withColumn("nbbo_coverage_pct", share(F.col("after"), F.col("before")))

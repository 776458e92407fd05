"""Cleaning of raw ticks: parsing, validity, condition codes, repeated rows, final schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CleaningConfig
from ..functions import conditions
from ..functions.stats import share
from ..functions.timefns import is_ambiguous, local_to_utc, not_nan

ORDER = ("ts", "type", "exch", "price", "size")
KEY = ("ts", "type", "price", "size", "exch", "cond_norm")
PART = ("ticker", "date")


def parse_raw(raw: DataFrame, zone: str = "America/New_York", row: str | None = None, part: tuple[str, ...] = ("ticker", "date_text")) -> DataFrame:
    """Strings to types: New York wall clock to UTC, coercing casts, and the date: that of the file (date_text, as
    M-d-yy) where there is one, else of the UTC time. Header rows (`Dates`) go; rows without a time, or with one that
    can't be parsed, stay with a NULL ts, so that they are counted.

    row: a column with a row's place in its part. With it, times that come twice when clocks go back are told apart as
    the rows run: in a part those after the clock's step back are the second ones. Without it they are the first."""
    local = F.try_to_timestamp(F.col("ts")).cast("timestamp_ntz")
    rows = raw.filter(F.coalesce(F.trim("ts") != "Dates", F.lit(True))).withColumn("ts", local)
    second = None
    if row is not None:
        w = Window.partitionBy(*part).orderBy(row)
        rows = rows.withColumn("_back", F.coalesce(F.col("ts") < F.lag("ts", 1).over(w), F.lit(False)) & is_ambiguous(F.col("ts"), zone))
        rows = rows.withColumn("_second", F.max("_back").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        second = F.col("_second")
    day = F.to_date(F.try_to_timestamp(F.col("date_text"), F.lit("M-d-yy"))) if "date_text" in raw.columns else F.lit(None).cast("date")
    rows = rows.withColumns({"ts": local_to_utc(F.col("ts"), zone, second), "price": not_nan(F.col("price").try_cast("double")), "size": F.col("size").try_cast("double")})
    rows = rows.withColumn("size", F.when(F.col("size") == F.floor("size"), F.col("size").cast("bigint")))
    return rows.withColumn("date", F.coalesce(day, F.col("ts").cast("date"))).drop("_back", "_second")


def drop_reason() -> Column:
    """The first test that a row fails; NULL for valid rows."""
    return (
        F.when(F.col("ts").isNull(), "null_ts")
        .when(F.coalesce(not_nan(F.col("price").cast("double")), F.lit(0.0)) <= 0, "invalid_price")
        .when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "invalid_size")
        .when(F.col("type").isNull(), "null_type")
    )


def valid_rows(ticks: DataFrame) -> DataFrame:
    return ticks.filter(drop_reason().isNull())


def drop_counts(ticks: DataFrame, by: tuple[str, ...] = PART) -> DataFrame:
    r = drop_reason()
    return ticks.groupBy(*by).agg(
        F.count("*").alias("raw_rows"),
        F.count_if(F.coalesce(r == "invalid_price", F.lit(False))).alias("dropped_invalid_price"),
        F.count_if(F.coalesce(r == "invalid_size", F.lit(False))).alias("dropped_invalid_size"),
        F.count_if(F.coalesce(r.isin("null_ts", "null_type"), F.lit(False))).alias("dropped_nulls"),
    )


def with_cond_norm(ticks: DataFrame, strict_null: bool = False) -> DataFrame:
    return ticks.withColumn("cond_norm", conditions.normalized(F.col("cond"), strict_null))


def dedup_keep_last(ticks: DataFrame, key: tuple[str, ...] = KEY, part: tuple[str, ...] = PART, source_key: str = "event_id") -> DataFrame:
    """One row of each key: the last by raw cond, then by source key. An aggregate, so equal rows shrink before
    the shuffle and no window has to sort them."""
    keys = list(dict.fromkeys([*part, *key]))
    rest = [c for c in ticks.columns if c not in keys]
    picked = ticks.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in sorted(rest, key=lambda c: (c != "cond", c != source_key))])).alias("_row"))
    return picked.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in ticks.columns])


def dedup_stats(ticks: DataFrame, key: tuple[str, ...] = KEY, part: tuple[str, ...] = PART) -> DataFrame:
    per = ticks.groupBy(*dict.fromkeys([*part, *key])).agg(F.count("*").alias("_n"))
    out = per.groupBy(*part).agg(F.sum("_n").alias("initial_rows"), (F.sum("_n") - F.count("*")).alias("duplicates_removed"))
    return out.withColumn("dup_pct", share(F.col("duplicates_removed"), F.col("initial_rows")))


def trades(ticks: DataFrame) -> DataFrame:
    return ticks.filter(F.col("type") == "TRADE")


def quotes(ticks: DataFrame) -> DataFrame:
    return ticks.filter(F.col("type").isin("BEST_BID", "BEST_ASK"))


def apply_cond_filter(rows: DataFrame) -> DataFrame:
    return rows.filter(conditions.kept(F.col("cond_norm")))


def cond_filter_stats(rows: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    """Rows before and after, dropped and its share, and the unknown codes as sorted text."""
    unknown = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(conditions.unknown_tokens(F.col("cond_norm")))))), ",")
    out = rows.groupBy(*part).agg(F.count("*").alias("before"), F.count_if(conditions.kept(F.col("cond_norm"))).alias("after"), unknown.alias("unknown_codes"))
    dropped = F.col("before") - F.col("after")
    return out.withColumns({"dropped": dropped, "dropped_pct": share(dropped, F.col("before"))})


def with_micro_flags(rows: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    near = lambda c: (F.abs(F.col("price") - F.col(c)) <= tolerance).cast("int")
    return rows.withColumns({"at_bid": near("nbb"), "at_ask": near("nbo")})


FINAL = ("ts", "ticker", "type", "price", "size", "cond", "cond_norm", "exch", "nbb", "nbo", "nbb_size", "nbo_size", "mid", "spread", "at_bid", "at_ask")


def finalize(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Fixed column order and narrow types."""
    kinds = {c: "float" for c in ("price", "nbb", "nbo", "mid", "spread")} | {c: "int" for c in ("size", "nbb_size", "nbo_size", "at_bid", "at_ask")}
    return rows.select(*keep, *[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in FINAL if c in rows.columns])


def prepared(raw: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Valid rows with cond_norm, without repeated ones."""
    return dedup_keep_last(with_cond_norm(valid_rows(raw), config.strict_null_cond))


def last_per_key_window(ticks: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """dedup_keep_last by row_number, for inputs without a source key."""
    w = Window.partitionBy(*key).orderBy(F.col("cond").desc_nulls_last())
    return ticks.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

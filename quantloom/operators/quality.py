"""Metadata of the cleaning and processing runs, quality gates and reports. A part that would have made a
file-by-file run fail is a row with a status here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CleaningConfig
from ..functions.stats import share
from ..session import written
from . import clean, nbbo

PART = ("ticker", "date")


def clean_metadata(raw: DataFrame, config: CleaningConfig = CleaningConfig(), part: tuple[str, ...] = PART) -> DataFrame:
    """A row for each part with the counters of every step."""
    valid = clean.with_cond_norm(clean.valid_rows(raw), config.strict_null_cond)
    # Read by several counters each, so written once.
    rows = written(clean.dedup_keep_last(valid, part=part), "metadata-rows")
    quotes, trades = clean.quotes(rows), clean.trades(rows)
    book = nbbo.build_nbbo(quotes, config.ffill_cap_seconds, part)
    merged = nbbo.merge_nbbo(trades, book)
    out = clean.drop_counts(raw, part)
    for more in (
        clean.dedup_stats(valid, part=part).select(*part, "duplicates_removed", "dup_pct"),
        nbbo.nbbo_stats(quotes, config.ffill_cap_seconds, part).select(*part, "crossed_quotes", "crossed_quotes_pct"),
        trades.groupBy(*part).agg(F.count("*").alias("_trades")),
        clean.cond_filter_stats(merged, part).select(*part, F.col("before").alias("_met"), F.col("after").alias("final_rows"), F.col("dropped").alias("trades_dropped_by_cond"), F.col("unknown_codes").alias("unknown_cond_codes")),
    ):
        out = out.join(more, list(part), "left")
    zero = [c for c in ("duplicates_removed", "dup_pct", "crossed_quotes", "crossed_quotes_pct", "_trades", "_met", "final_rows", "trades_dropped_by_cond")]
    out = out.na.fill(0, zero).na.fill("", ["unknown_cond_codes"])
    out = out.withColumns({"trades_dropped_no_nbbo": F.col("_trades") - F.col("_met"), "nbbo_coverage_pct": share(F.col("_met"), F.col("_trades"))})
    return out.withColumns({"status": F.when(F.col("final_rows") > 0, "success").otherwise("failed"), "error": _error()}).drop("_trades", "_met")


def _error() -> Column:
    """Why a part failed: the first step that left none of its rows; empty where it didn't fail."""
    dropped = F.col("dropped_invalid_price") + F.col("dropped_invalid_size") + F.col("dropped_nulls")
    return (
        F.when(F.col("final_rows") > 0, "")
        .when(F.col("raw_rows") <= dropped, "no valid rows")
        .when(F.col("_trades") == 0, "no trades")
        .when(F.col("_met") == 0, "no quotes for any trade")
        .otherwise("no trades left by the condition filter")
    )


def quality_gates(metadata: DataFrame, config: CleaningConfig = CleaningConfig()) -> DataFrame:
    """Parts that break a gate and which; a warning, nothing is dropped."""
    low, crossed = F.col("nbbo_coverage_pct") < config.min_nbbo_coverage_pct, F.col("crossed_quotes_pct") > config.max_crossed_quotes_pct
    return metadata.filter("status = 'success'").filter(low | crossed).select(*PART, "nbbo_coverage_pct", "crossed_quotes_pct", low.alias("low_coverage"), crossed.alias("many_crossed"))


def run_summary(metadata: DataFrame) -> DataFrame:
    ok = metadata.filter("status = 'success'")
    total = lambda c: F.sum(c).alias(f"total_{c}")
    return ok.agg(F.count("*").alias("n_success"), *[total(c) for c in ("raw_rows", "final_rows", "duplicates_removed", "crossed_quotes", "trades_dropped_by_cond", "trades_dropped_no_nbbo")], F.avg("dup_pct").alias("mean_dup_pct"), F.avg("nbbo_coverage_pct").alias("mean_coverage"))


def metadata_report(metadata: DataFrame) -> DataFrame:
    """Per ticker: rows in and out, retention and means, largest first."""
    out = metadata.groupBy("ticker").agg(F.count("*").alias("parts"), F.sum("raw_rows").alias("raw_rows"), F.sum("final_rows").alias("final_rows"), F.round(F.avg("dup_pct"), 2).alias("mean_dup_pct"), F.round(F.avg("nbbo_coverage_pct"), 2).alias("mean_coverage"))
    return out.withColumn("retention_pct", F.round(share(F.col("final_rows"), F.col("raw_rows")), 2)).orderBy(F.desc("final_rows"), "ticker")


def inspect_sample(cleaned: DataFrame, part: tuple[str, ...] = PART, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Null counts, price statistics, shares at the bid and ask, odd spreads, and whether time runs forward."""
    w = Window.partitionBy(*part).orderBy(*order[1:])
    rows = cleaned.withColumn("_back", F.coalesce(F.col("ts") < F.lag("ts").over(w), F.lit(False)))
    at = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy(*part).agg(
        F.count("*").alias("n"), F.count_if(F.col("mid").isNull()).alias("null_mid"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("mean_price"), F.median("price").alias("median_price"),
        at("at_bid").alias("share_at_bid"), at("at_ask").alias("share_at_ask"), F.count_if((F.col("price") > F.col("nbb")) & (F.col("price") < F.col("nbo"))).alias("between"),
        F.count_if(F.col("spread") < 0).alias("negative_spreads"), F.count_if(F.col("spread") == 0).alias("zero_spreads"), (F.count_if("_back") == 0).alias("monotonic"),
    )


def processing_summary(labelled: DataFrame, part: tuple[str, ...] = PART) -> DataFrame:
    """Per part: bars, volume, duration, labelled rows and the distribution of labels as JSON."""
    counts = F.to_json(F.create_map(*[x for v in (-1, 0, 1) for x in (F.lit(str(v)), F.count_if(F.col("label") == v))]))
    return labelled.groupBy(*part).agg(
        F.count("*").alias("n_bars"), F.sum("trade_count").alias("n_trades"), F.avg("volume").alias("avg_bar_volume"), F.avg("duration_seconds").alias("avg_bar_duration_seconds"),
        F.count_if(F.col("label_barrier_hit") != "").alias("n_labeled"), F.count_if(F.col("label_barrier_hit") == "").alias("n_unlabeled"), counts.alias("label_dist"),
    )

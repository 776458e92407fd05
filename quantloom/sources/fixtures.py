"""Tick relations derived from the test tables, so that every operator has inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefns import floor_to, week_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ticker, date (its week), ts, type, price, size, exch, cond: quotes and trades with invalid
    sizes, repeated rows under another spelling of cond, unknown codes, ties and crossed quotes."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "view", "BEST_BID").when(F.col("event_type") == "signup", "BEST_ASK").otherwise("TRADE")
    level = F.when(F.col("event_type") == "view", 100.0).when(F.col("event_type") == "signup", 100.9).otherwise(100.4)
    cond = F.element_at(F.array(*map(F.lit, ["I", "F", " f , is", "", "T,F", "QQ", "0", "0", "0", "0"])), (F.col("event_id") % 10 + 1).cast("int"))
    base = e.select(
        "event_id",
        F.concat(F.lit("T"), F.col("user_id") % 4).alias("ticker"),
        week_start("ts").alias("date"),
        floor_to("ts", 60_000_000).alias("ts"),
        kind.alias("type"),
        (level + (F.col("value") - 50) / 100).alias("price"),
        F.col("k").alias("size"),
        F.char(65 + F.col("user_id") % 7).alias("exch"),
        cond.alias("cond"),
    )
    # The repeated rows come from the same scan: one generator row more, no second read.
    again = F.explode(F.when(F.col("event_id") % 20 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.withColumn("_again", again).withColumn("cond", F.when(F.col("_again") == 1, F.concat(F.upper("cond"), F.lit(","))).otherwise(F.col("cond"))).drop("_again")


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, ts, price, size and tie-breaking keys from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.make_date(F.year("l_shipdate"), F.lit(1), F.lit(1)).alias("date"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_extendedprice").alias("k5"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with made-up but fixed probabilities and predictions, so that metrics have exact answers:
    id, date, ticker, y, proba, label, ewm_std, pred_q10, pred_q50, feat_vwap_zscore, t."""
    o = table(spark, sf_dir, "orders")
    h = lambda a, m: F.pmod(F.col("o_orderkey") * a, F.lit(m))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.date_add(F.lit("2025-10-01").cast("date"), h(31, 5).cast("int")).alias("date"),
        F.concat(F.lit("T"), h(17, 7)).alias("ticker"),
        (h(7919, 1000) / 1000.0).alias("proba"),
        (h(104729, 3) - 1).cast("int").alias("label"),
        (h(6151, 97) / 9700.0 + 0.001).alias("ewm_std"),
        (h(3571, 200) / 10000.0 - 0.015).alias("pred_q10"),
        (h(2741, 200) / 10000.0 - 0.01).alias("pred_q50"),
        (h(1543, 41) / 10.0 - 2.0).alias("feat_vwap_zscore"),
        F.timestamp_add("SECOND", h(9973, 100_003).cast("int"), F.lit("2025-10-01 13:35:00").cast("timestamp_ntz")).alias("t"),
    ).withColumn("y", (F.col("label") == 1).cast("int"))

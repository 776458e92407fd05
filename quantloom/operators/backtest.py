"""Back-test: directions, simulated trades, metrics and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def test_day(df: DataFrame, day: str, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) == F.lit(day).cast("date"))


def trade_direction(df: DataFrame) -> DataFrame:
    """Long below a z-score of zero, short otherwise (also for NULL and NaN)."""
    long = F.coalesce(F.col("feat_vwap_zscore") < 0, F.lit(False))
    return df.withColumns({"trade_direction": F.when(long, 1).otherwise(-1), "trade_direction_label": F.when(long, "LONG").otherwise("SHORT")})


def simulate(df: DataFrame, threshold: float = 0.5, proba: str = "rf_proba_reversion", stop: str = "gbm_pred_q10", target: str = "gbm_pred_q50") -> DataFrame:
    """Trades of sufficient probability with outcome and pnl (the forward return, whatever the direction)."""
    outcome = F.when(F.col("label") == 1, "WIN").when(F.col("label") == -1, "LOSS").when(F.col("label") == 0, "TIMEOUT")
    return trade_direction(df).filter(F.col(proba) >= threshold).withColumns({"outcome": outcome, "pnl": F.col("forward_return"), "pred_stop": F.col(stop), "pred_target": F.col(target)})


def _metrics() -> list[Column]:
    win, loss = F.col("outcome") == "WIN", F.col("outcome") == "LOSS"
    avg_win, avg_loss = F.coalesce(F.avg(F.when(win, F.col("pnl"))), F.lit(0.0)), F.coalesce(F.avg(F.when(loss, F.col("pnl"))), F.lit(0.0))
    std = F.stddev_samp("pnl")
    ratio = F.when(avg_loss != 0, F.abs(avg_win / F.when(avg_loss != 0, avg_loss))).when(avg_win > 0, F.lit(float("inf")))
    n = F.count("*")
    return [
        n.alias("n_trades"), F.count_if(win).alias("n_wins"), F.count_if(loss).alias("n_losses"), F.count_if(F.col("outcome") == "TIMEOUT").alias("n_timeouts"),
        F.when(n > 0, F.count_if(win) / F.when(n > 0, n)).alias("hit_rate"), avg_win.alias("avg_win"), avg_loss.alias("avg_loss"), ratio.alias("win_loss_ratio"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"), F.avg("pnl").alias("mean_pnl"), std.alias("std_pnl"),
        F.when(std > 0, F.avg("pnl") / F.when(std > 0, std) * F.sqrt(n.cast("double"))).alias("sharpe"), F.max(F.when(win, F.col("pnl"))).alias("max_win"), F.min(F.when(loss, F.col("pnl"))).alias("max_loss"),
    ]


def metrics(trades: DataFrame) -> DataFrame:
    """One row; ratios without a denominator are NULL, and infinite where there are wins but no losses."""
    return trades.agg(*_metrics())


def metrics_by(trades: DataFrame, by: str = "ticker") -> DataFrame:
    return trades.groupBy(by).agg(*_metrics()).orderBy(F.desc("total_pnl"), by)


def cumulative_pnl(trades: DataFrame, order: tuple[str, ...] = ("t", "id"), by: tuple[str, ...] = ()) -> DataFrame:
    """trade_num and cum_pnl in time order: sums of days first, so that only rows of one day are sorted together."""
    days = trades.withColumn("_day", F.col(order[0]).cast("date"))
    before = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    offset = days.groupBy(*by, "_day").agg(F.sum("pnl").alias("_p"), F.count("*").alias("_c")).select(*by, "_day", F.coalesce(F.sum("_p").over(before), F.lit(0.0)).alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c"))
    inside = Window.partitionBy(*by, "_day").orderBy(*order)
    rows = days.withColumns({"_sum": F.sum("pnl").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_no": F.row_number().over(inside)})
    return rows.join(offset, [*by, "_day"]).select(*trades.columns, (F.col("_c") + F.col("_no")).alias("trade_num"), (F.col("_p") + F.col("_sum")).alias("cum_pnl"))


def outcome_stats(trades: DataFrame) -> DataFrame:
    return trades.groupBy("outcome").agg(F.count("*").alias("n"), F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("std"), F.min("pnl").alias("min"), F.max("pnl").alias("max"))


def prediction_correlation(trades: DataFrame, columns: tuple[str, ...] = ("pred_stop", "pred_target")) -> DataFrame:
    return trades.agg(*[F.corr("pnl", c).alias(f"corr_{c}") for c in columns])


def top_and_bottom(per: DataFrame, n: int = 3, column: str = "total_pnl", key: str = "ticker") -> DataFrame:
    top = per.orderBy(F.desc(column), key).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(per.orderBy(F.asc(column), F.desc(key)).limit(n).withColumn("side", F.lit("bottom")))


def metrics_table(one: dict) -> str:
    """Metrics as a markdown table."""
    show = lambda v: "n/a" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    return "\n".join(["| metric | value |", "| --- | --- |", *[f"| {k} | {show(v)} |" for k, v in one.items()]])


def rows_table(rows: list[dict]) -> str:
    if not rows:
        return ""
    show = lambda v: "n/a" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    head = list(rows[0])
    return "\n".join([f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *[f"| {' | '.join(show(r[k]) for k in head)} |" for r in rows]])


def html_table(rows: list[dict]) -> str:
    from html import escape

    head = "".join(f"<th>{escape(str(k))}</th>" for k in (rows[0] if rows else {}))
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"

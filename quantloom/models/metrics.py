"""Metrics of classifiers, quantile regressors and scores; all are single aggregates or windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import percentiles, running_sums


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def _rates(c: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": _ratio(tp + tn, tp + fp + fn + tn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def roc_auc(df: DataFrame, y: str = "y", score: str = "proba") -> DataFrame:
    """auc by mid-ranks (NULL if there is one class): counts of equal scores first, then ranks of the distinct
    scores from running counts over their ranges."""
    per = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("bigint")).alias("_p"), F.count("*").alias("_n"))
    ranked = running_sums(per, "_s", ("_n",)).withColumn("_r", F.col("cum__n") - F.col("_n") + (F.col("_n") + 1) / 2)
    out = ranked.agg(F.sum(F.col("_p") * F.col("_r")).alias("_sum"), F.sum("_p").cast("double").alias("_pos"), F.sum(F.col("_n") - F.col("_p")).cast("double").alias("_neg"))
    return out.select(F.when((F.col("_pos") > 0) & (F.col("_neg") > 0), (F.col("_sum") - F.col("_pos") * (F.col("_pos") + 1) / 2) / (F.col("_pos") * F.col("_neg"))).alias("auc"))


def classification_metrics(df: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "proba") -> DataFrame:
    """accuracy, precision, recall, f1 (0 where undefined) and auc."""
    rates = _rates(confusion(df.withColumn("pred", (F.col(score) >= threshold).cast("int")), y))
    return rates.crossJoin(roc_auc(df, y, score)).select("accuracy", "precision", "recall", "f1", "auc")


def threshold_sweep(df: DataFrame, steps: int = 100, y: str = "y", score: str = "proba") -> DataFrame:
    """Metrics at 0, 1/steps, ..., 1. A row falls into the last threshold it reaches, and counts accumulate from
    above, so the rows aren't multiplied by the thresholds."""
    top = F.greatest(F.least(F.floor(F.col(score) * steps + 1e-9), F.lit(steps)), F.lit(-1)).cast("int")
    per = df.groupBy(top.alias("i")).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.count("*").alias("n"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("i")).join(per, "i", "left").na.fill(0)
    above, every = Window.orderBy(F.desc("i")), Window.partitionBy(F.lit(0))
    c = grid.withColumns({"tp": F.sum("p").over(above), "_all": F.sum("n").over(above), "_pos": F.sum("p").over(every), "_rows": F.sum("n").over(every)}).filter("i >= 0")
    c = c.withColumns({"fp": F.col("_all") - F.col("tp"), "fn": F.col("_pos") - F.col("tp")}).withColumn("tn", F.col("_rows") - F.col("_all") - F.col("fn"))
    return _rates(c).select((F.col("i") / float(steps)).alias("threshold"), "precision", "recall", "f1", "accuracy")


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def roc_pr_curve(df: DataFrame, y: str = "y", score: str = "proba") -> DataFrame:
    """threshold, tpr, fpr, precision, recall at each distinct score."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(y).cast("bigint")).alias("p"), F.count("*").alias("n"))
    c = running_sums(per, "threshold", ("p", "n"), descending=True)
    tp, seen, pos, rows = (F.col(x) for x in ("cum_p", "cum_n", "all_p", "all_n"))
    return c.select("threshold", _ratio(tp, pos).alias("tpr"), _ratio(seen - tp, rows - pos).alias("fpr"), _ratio(tp, seen).alias("precision"))


def calibration_curve(df: DataFrame, bins: int = 10, y: str = "y", score: str = "proba") -> DataFrame:
    """bin, mean_pred, mean_y of quantile bins; edges are exact percentiles and empty bins go."""
    edges = percentiles(df, score, [i / bins for i in range(1, bins)]).select(F.col("q").alias("_e"))
    at = F.size(F.filter("_e", lambda e: e < F.col(score)))
    return df.crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def pinball(actual: str | Column, pred: str, tau: float) -> Column:
    r = (F.col(actual) if isinstance(actual, str) else actual) - F.col(pred)
    return F.avg(F.when(r >= 0, tau * r).otherwise((tau - 1) * r))


def coverage_rate(actual: str, pred: str) -> Column:
    return F.avg((F.col(actual) <= F.col(pred)).cast("double"))


def quantile_metrics(df: DataFrame, actual: str, predictions: dict[float, str], by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each quantile: expected and actual coverage, calibration error, pinball loss, residual and
    prediction statistics (population deviation), next to those of the target."""
    long = df.select(*by, actual, F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.col(c).alias("pred")) for t, c in predictions.items()])).alias("_p")).select(*by, actual, "_p.*")
    r = F.col(actual) - F.col("pred")
    covered = coverage_rate(actual, "pred")
    return long.groupBy(*by, "tau").agg(
        F.count("*").alias("n"), F.avg(actual).alias("y_mean"), F.stddev_pop(actual).alias("y_std"), F.min(actual).alias("y_min"), F.max(actual).alias("y_max"),
        F.avg(F.when(r >= 0, F.col("tau") * r).otherwise((F.col("tau") - 1) * r)).alias("pinball"), covered.alias("coverage"), F.abs(covered - F.first("tau")).alias("calibration_error"),
        F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"), F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"),
    )


def interval_metrics(df: DataFrame, actual: str, lower: str, upper: str) -> DataFrame:
    y, a, b = F.col(actual), F.col(lower), F.col(upper)
    mean = lambda c: F.avg(c.cast("double"))
    return df.agg(F.avg(b - a).alias("mean_width"), mean((y >= a) & (y <= b)).alias("coverage"), mean(y < a).alias("below"), mean(y > b).alias("above"))


def summarize_grid(results: DataFrame, top: int | None = None) -> DataFrame:
    """Grid rows by mean pinball loss, best first."""
    out = results.orderBy("mean_pinball", *[c for c in results.columns if c != "mean_pinball"])
    return out.limit(top) if top else out

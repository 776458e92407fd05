"""Random-forest opportunity classifier on flagged candidates."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .metrics import classification_metrics
from .scaling import fit_scaler, scale

#: The grid of trees, depth (None: as deep as MLlib goes), rows of a leaf, features of a split (fixed values).
GRID = {"trees": (200, 400), "depth": (None, 10), "leaf": (5, 10), "features": ("sqrt", "all")}


def opportunities(candidates: DataFrame, flag: str = "gmm_is_candidate") -> DataFrame:
    """Flagged rows without NULLs, with day and the target y."""
    return candidates.filter(flag).na.drop().withColumns({"y": (F.col("label") == 1).cast("int"), "day": F.col("date")})


def fit(df: DataFrame, columns: list[str], trees: int = 400, depth: int | None = None, leaf: int = 5, features: str = "all", seed: int = 42) -> tuple[RandomForestClassificationModel, dict]:
    """The model and the scaler that was fitted on the same rows. Splits are those of histograms."""
    scaler = fit_scaler(df, columns)
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(scale(df, scaler))
    rf = RandomForestClassifier(labelCol="y", featuresCol="_x", numTrees=trees, maxDepth=30 if depth is None else depth, minInstancesPerNode=leaf, featureSubsetStrategy=features, seed=seed)
    return rf.fit(rows), scaler


def score(df: DataFrame, model: RandomForestClassificationModel, scaler: dict, columns: list[str], out: str = "rf_proba_reversion") -> DataFrame:
    keep = df.select("*", F.struct(*columns).alias("_kept"))
    rows = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(scale(keep, scaler))
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*[F.col(f"_kept.{c}").alias(c) if c in columns else F.col(c) for c in df.columns], out)


def tune(df: DataFrame, columns: list[str], day: str = "day", grid: dict = GRID, seed: int = 42) -> tuple[dict, list[dict]]:
    """Leave-one-day-out metrics of each grid point; the strictly best mean F1 wins."""
    df = written(df.select(*columns, day, "y"), "tuning")  # read again for each fold and grid point
    days, results = [r[0] for r in df.select(day).distinct().orderBy(day).collect()], []
    for values in product(*grid.values()):
        point = dict(zip(grid, values, strict=True))
        rows = []
        for d in days:
            train, val = df.filter(F.col(day) != d), df.filter(F.col(day) == d)
            if train.isEmpty() or val.isEmpty():
                continue
            model, scaler = fit(train, columns, seed=seed, **point)
            rows.append(classification_metrics(score(val, model, scaler, columns), score="rf_proba_reversion").first().asDict())
        mean = {k: float(np.nanmean([math.nan if r[k] is None else r[k] for r in rows])) if rows else math.nan for k in ("accuracy", "precision", "recall", "f1", "auc")}
        results.append(point | mean)
    best = max(results, key=lambda r: -math.inf if math.isnan(r["f1"]) else r["f1"])
    return {k: best[k] for k in grid}, results


def importances(model: RandomForestClassificationModel, columns: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(columns, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))

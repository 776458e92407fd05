"""Saving and loading models: parameters as JSON, MLlib's parts in their own format; any store Spark writes to."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import SparkSession

from ..sources.ticks import load_json, save_json
from .gmm import GMMParams, Mixture
from .quantile_boost import QuantileBoost


def save_mixture(spark: SparkSession, model: Mixture, path: str, **config: object) -> None:
    save_json(spark, model.to_dict() | {"config": config}, path)


def load_mixture(spark: SparkSession, path: str) -> Mixture:
    d = load_json(spark, path)
    return Mixture(GMMParams(len(d["weights"]), d["covariance_type"]), d["columns"], np.array(d["weights"]), np.array(d["means"]), np.array(d["covariances"]), d["loglik"])


def save_forest(spark: SparkSession, model: RandomForestClassificationModel, scaler: dict, columns: list[str], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    save_json(spark, {"scaler": scaler, "columns": columns}, f"{path}/config")


def load_forest(spark: SparkSession, path: str) -> tuple[RandomForestClassificationModel, dict, list[str]]:
    d = load_json(spark, f"{path}/config")
    return RandomForestClassificationModel.load(f"{path}/model"), {k: tuple(v) for k, v in d["scaler"].items()}, d["columns"]


def save_boost(spark: SparkSession, model: QuantileBoost, path: str) -> None:
    for i, (tree, _) in enumerate(model.trees):
        tree.write().overwrite().save(f"{path}/tree-{i}")
    save_json(spark, {"quantile": model.quantile, "base": model.base, "rate": model.rate, "columns": model.columns, "leaves": [{str(k): v for k, v in x.items()} for _, x in model.trees]}, f"{path}/config")


def load_boost(spark: SparkSession, path: str) -> QuantileBoost:
    d = load_json(spark, f"{path}/config")
    trees = [(DecisionTreeRegressionModel.load(f"{path}/tree-{i}"), {int(k): v for k, v in x.items()}) for i, x in enumerate(d["leaves"])]
    return QuantileBoost(d["quantile"], d["base"], d["rate"], d["columns"], trees)

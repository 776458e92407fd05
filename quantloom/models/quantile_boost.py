"""Quantile gradient boosting: trees on the pinball loss's gradient, leaves refitted to residual quantiles
(Friedman 2001). MLlib has no quantile loss, so the boosting loop is here and MLlib grows the trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentiles
from ..session import written
from .metrics import pinball

#: The tuning grid (fixed values).
GRID = {"n_estimators": (100, 200), "max_depth": (3, 5), "learning_rate": (0.05, 0.1), "min_samples_leaf": (10, 20)}
#: Rounds after which the state is written to a table, so that plans and lost executors cost little.
CUT_EVERY = 10


@dataclass
class QuantileBoost:
    quantile: float
    base: float
    rate: float
    columns: list[str]
    trees: list[tuple[DecisionTreeRegressionModel, dict[int, float]]] = field(default_factory=list)

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """df with the sum of all trees, in one Arrow function however many trees there are."""
        base, rate, trees = self.base, self.rate, [_arrays(t, leaves) for t, leaves in self.trees]

        @F.pandas_udf("double")
        def predicted(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for p in parts:
                x = np.stack([c.to_numpy(dtype=float) for c in (p if isinstance(p, tuple) else (p,))], axis=1)
                total, every = np.full(len(x), base), np.arange(len(x))
                for feature, threshold, left, right, value in trees:
                    node = np.zeros(len(x), np.int64)
                    while (inner := feature[node] >= 0).any():
                        f = np.maximum(feature[node], 0)
                        node = np.where(inner, np.where(x[every, f] <= threshold[node], left[node], right[node]), node)
                    total += rate * value[node]
                yield pd.Series(total)

        return df.withColumn(out, predicted(*[F.col(c).cast("double") for c in self.columns]))


def _arrays(tree: DecisionTreeRegressionModel, leaves: dict[int, float]) -> tuple[np.ndarray, ...]:
    """Feature (-1: a leaf), threshold, left and right child, value of a tree's nodes, which are at most 2 ** depth * 2.
    Leaves are numbered from left to right, as MLlib's leaf column numbers them."""
    nodes: list[list[float]] = []
    found = iter(range(1 << 30))

    def walk(node) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        if node.getClass().getSimpleName() == "InternalNode":
            nodes[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            nodes[at][2] = walk(node.leftChild())
            nodes[at][3] = walk(node.rightChild())
        else:
            nodes[at][4] = leaves.get(next(found), 0.0)
        return at

    walk(tree._call_java("rootNode"))
    columns = list(zip(*nodes, strict=True))
    return tuple(np.array(c, k) for c, k in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True))


def train(df: DataFrame, columns: list[str], target: str, quantile: float = 0.5, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, min_samples_leaf: int = 10, seed: int = 42) -> QuantileBoost:
    rows = written(VectorAssembler(inputCols=columns, outputCol="_x").transform(df).select("_x", F.col(target).cast("double").alias("_y")), "boost")
    base = float(percentiles(rows, "_y", [quantile]).first()[0][0])
    model = QuantileBoost(quantile, base, learning_rate, columns)
    rows = rows.withColumn("_f", F.lit(base))
    grower = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", predictionCol="_p", leafCol="_leaf", maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, seed=seed)
    for i in range(n_estimators):
        rows = rows.withColumn("_g", F.when(F.col("_y") >= F.col("_f"), F.lit(quantile)).otherwise(quantile - 1))
        tree = grower.fit(rows)
        placed = tree.transform(rows)
        rest = placed.select("_leaf", (F.col("_y") - F.col("_f")).alias("_rest"))
        leaves = {int(r["_leaf"]): float(r["q"][0]) for r in percentiles(rest, "_rest", [quantile], ("_leaf",)).collect()}  # at most 2 ** max_depth
        value = F.create_map(*[F.lit(v) for kv in leaves.items() for v in (float(kv[0]), kv[1])])
        rows = placed.withColumn("_f", F.col("_f") + learning_rate * F.try_element_at(value, F.col("_leaf"))).select("_x", "_y", "_f")
        if (i + 1) % CUT_EVERY == 0:
            rows = written(rows, "boost")
        model.trees.append((tree, leaves))
    return model


def tune(df: DataFrame, columns: list[str], target: str, day: str, quantile: float = 0.5, grid: dict = GRID, seed: int = 42) -> tuple[dict, list[dict]]:
    """Leave-one-day-out pinball loss of each grid point; the least mean wins."""
    df = written(df.select(*columns, target, day), "tuning")  # read again for each fold and grid point
    days, results = [r[0] for r in df.select(day).distinct().orderBy(day).collect()], []
    for values in product(*grid.values()):
        point, losses = dict(zip(grid, values, strict=True)), []
        for d in days:
            part, val = df.filter(F.col(day) != d), df.filter(F.col(day) == d)
            if not part.isEmpty() and not val.isEmpty():
                losses.append(train(part, columns, target, quantile, seed=seed, **point).predict(val, "_q").agg(pinball(target, "_q", quantile)).first()[0])
        results.append(point | {"mean_pinball": float(np.nanmean(losses)) if losses else math.nan, "std_pinball": float(np.nanstd(losses)) if losses else math.nan})
    best = min(results, key=lambda r: math.inf if math.isnan(r["mean_pinball"]) else r["mean_pinball"])
    return {k: best[k] for k in grid}, results

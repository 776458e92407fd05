"""Gaussian mixtures by expectation maximisation: full or diagonal covariance, ridge, k-means start.

A pass sums each component's weight, mean and second moment on the executors (one small row for each task and
component) and adds them up; the driver holds only parameters. Per-row log densities use Cholesky factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentiles
from ..functions.stats import aic, bic


@dataclass(frozen=True)
class GMMParams:
    n_components: int
    covariance_type: str = "full"
    seed: int = 42
    max_iter: int = 500
    reg_covar: float = 1e-6
    tol: float = 1e-3


@dataclass
class Mixture:
    params: GMMParams
    columns: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # k x d x d; diagonal ones too
    loglik: float = float("nan")
    iterations: int = 0
    history: list[float] = field(default_factory=list)

    def n_parameters(self) -> int:
        k, d = self.means.shape
        return k * d + k - 1 + (k * d * (d + 1) // 2 if self.params.covariance_type == "full" else k * d)

    def to_dict(self) -> dict:
        return {"columns": self.columns, "weights": self.weights.tolist(), "means": self.means.tolist(), "covariances": self.covariances.tolist(), "covariance_type": self.params.covariance_type, "loglik": self.loglik}


def _density_maker(weights, means, covariances):
    """A function from rows to log(weight * density) of each component, without references to this module."""
    factors = [np.linalg.cholesky(c) for c in covariances]
    consts = [math.log(max(w, 1e-300)) - 0.5 * len(m) * math.log(2 * math.pi) - float(np.log(np.diag(f)).sum()) for w, m, f in zip(weights, means, factors, strict=True)]
    inverses = [np.linalg.inv(f) for f in factors]
    means = list(means)

    def density(x):
        import numpy as np

        return np.stack([c - 0.5 * (((x - m) @ i.T) ** 2).sum(1) for c, m, i in zip(consts, means, inverses, strict=True)], axis=1)

    return density


def _moments(df: DataFrame, columns: list[str], respond) -> list[tuple]:
    """Per component: sum of responsibilities, of x, of x x'; and the log likelihood."""
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        n = s1 = s2 = None
        ll, rows = 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[:d]], axis=1)
            r, l = respond(x, b.columns[d].to_numpy(zero_copy_only=False) if b.num_columns > d else None)
            if n is None:
                n, s1, s2 = np.zeros(r.shape[1]), np.zeros((r.shape[1], d)), np.zeros((r.shape[1], d, d))
            n += r.sum(0)
            s1 += r.T @ x
            s2 += np.einsum("nk,ni,nj->kij", r, x, x, optimize=True)
            ll += l
            rows += len(x)
        if n is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(s1.tolist()), pa.array(s2.reshape(len(n), -1).tolist()), pa.array([ll] * len(n)), pa.array([rows] * len(n))], names=["k", "n", "s1", "s2", "ll", "rows"])

    parts = df.mapInArrow(run, "k int, n double, s1 array<double>, s2 array<double>, ll double, rows bigint")
    add = lambda c, m: F.array(*[F.sum(F.col(c)[i]) for i in range(m)])
    return sorted(tuple(r) for r in parts.groupBy("k").agg(F.sum("n"), add("s1", d), add("s2", d * d), F.sum("ll"), F.sum("rows")).collect())


def _maximised(stats: list[tuple], params: GMMParams, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([max(s[1], 1e-10) for s in stats])
    means = np.array([s[2] for s in stats]) / n[:, None]
    second = np.array([s[3] for s in stats]).reshape(-1, d, d) / n[:, None, None]
    cov = second - np.einsum("ki,kj->kij", means, means)
    if params.covariance_type == "diag":
        cov = np.stack([np.diag(np.maximum(np.diag(c), 0)) for c in cov])
    return n / n.sum(), means, cov + params.reg_covar * np.eye(d)


def fit(df: DataFrame, columns: list[str], params: GMMParams) -> Mixture:
    """df is read once for each iteration: cache it or keep it in a table."""
    x, k, d = df.select(*[F.col(c).cast("double").alias(c) for c in columns]), params.n_components, len(columns)
    assembled = VectorAssembler(inputCols=columns, outputCol="_v").transform(x)
    start = KMeans(k=k, seed=params.seed, featuresCol="_v", predictionCol="_k", maxIter=20).fit(assembled).transform(assembled).select(*columns, "_k")

    def hard(rows, cluster):
        import numpy as np

        return np.eye(k)[cluster], 0.0

    stats = _moments(start, columns, hard)
    found = {s[0]: s for s in stats}
    stats = [found.get(i, (i, 0.0, [0.0] * d, [0.0] * d * d, 0.0, 0)) for i in range(k)]
    weights, means, cov = _maximised(stats, params, d)
    model, last = Mixture(params, columns, weights, means, cov), -math.inf
    for i in range(params.max_iter):
        density = _density_maker(model.weights, model.means, model.covariances)

        def soft(rows, _, density=density):
            import numpy as np

            p = density(rows)
            top = p.max(1, keepdims=True)
            total = top + np.log(np.exp(p - top).sum(1, keepdims=True))
            return np.exp(p - total), float(total.sum())

        stats = _moments(x, columns, soft)
        ll = stats[0][4] / max(stats[0][5], 1)
        model.history.append(ll)
        model.loglik, model.iterations = ll, i + 1
        if ll - last < params.tol:
            break
        last = ll
        model.weights, model.means, model.covariances = _maximised(stats, params, d)
    return model


def score(df: DataFrame, model: Mixture, prefix: str = "gmm_") -> DataFrame:
    """df with the log likelihood of each row and its most likely component."""
    density, columns = _density_maker(model.weights, model.means, model.covariances), model.columns

    @F.pandas_udf("loglik double, component int")
    def scores(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        for p in parts:
            x = np.stack([c.to_numpy(dtype=float) for c in (p if isinstance(p, tuple) else (p,))], axis=1)
            d = density(x)
            top = d.max(1)
            yield pd.DataFrame({"loglik": top + np.log(np.exp(d - top[:, None]).sum(1)), "component": d.argmax(1).astype("int32")})

    out = df.withColumn("_s", scores(*[F.col(c).cast("double") for c in columns]))
    return out.select(*df.columns, F.col("_s.loglik").alias(f"{prefix}loglik"), F.col("_s.component").alias(f"{prefix}component"))


def tune(df: DataFrame, columns: list[str], day: str, grid: list[GMMParams]) -> tuple[Mixture, list[dict]]:
    """Leave-one-day-out log likelihood of each grid point; of those within one standard deviation of the best,
    the one with the lowest BIC is fitted on everything. A point that fails counts as missing."""
    days = [r[0] for r in df.select(day).distinct().orderBy(day).collect()]
    n, results = df.count(), []
    for p in grid:
        lls = []
        for d in days:
            train, val = df.filter(F.col(day) != d), df.filter(F.col(day) == d)
            try:
                lls.append(score(val, fit(train, columns, p)).agg(F.avg("gmm_loglik")).first()[0])
            except np.linalg.LinAlgError:
                continue
        whole = fit(df, columns, p)
        k = whole.n_parameters()
        results.append({"params": p, "mean": float(np.mean(lls)) if lls else math.nan, "std": float(np.std(lls)) if lls else math.nan, "aic": aic(whole.loglik * n, k), "bic": bic(whole.loglik * n, k, n), "model": whole})
    known = [r for r in results if not math.isnan(r["mean"])] or results
    best = max(known, key=lambda r: (-math.inf if math.isnan(r["mean"]) else r["mean"]))
    near = [r for r in known if r["mean"] >= best["mean"] - best["std"]] or known
    chosen = min(near, key=lambda r: r["bic"])
    return chosen["model"], [{k: v for k, v in r.items() if k != "model"} for r in results]


def choose_threshold(scored: DataFrame, quantile: float = 0.05, column: str = "gmm_loglik") -> DataFrame:
    """threshold (linear interpolation), mean and population deviation of the scores; quantile clipped to [0, 1]."""
    q = min(max(quantile, 0.0), 1.0)
    moments = scored.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
    return percentiles(scored, column, [q]).select(F.col("q")[0].alias("threshold")).crossJoin(moments)


def flag_candidates(scored: DataFrame, threshold: DataFrame, column: str = "gmm_loglik") -> DataFrame:
    out = scored.crossJoin(F.broadcast(threshold.select("threshold")))
    return out.withColumn("gmm_is_candidate", F.col(column) <= F.col("threshold")).drop("threshold")


def candidate_metrics(flagged: DataFrame, by: tuple[str, ...] = ("split",), column: str = "gmm_loglik") -> DataFrame:
    hit = F.col("gmm_is_candidate")
    count = lambda f, v: F.count_if((hit if f else ~hit) & (F.col("label") == v))
    names = {1: "up", -1: "down", 0: "zero"}
    return flagged.groupBy(*by).agg(F.count("*").alias("n"), F.avg(column).alias("mean_loglik"), F.avg(hit.cast("double")).alias("candidate_rate"), *[count(f, v).alias(f"{'flagged' if f else 'other'}_{w}") for f in (True, False) for v, w in names.items()])

"""Mixture, boosting, forest and metrics by their properties; reports and streams."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.models import forest, gmm, metrics, persist, quantile_boost, scaling
from quantloom.operators import backtest, explore
from quantloom.sources import ticks
from quantloom.streaming import ticks as stream


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.normal((0, 0) if i % 2 else (6, 3), (1, 0.5)))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double").cache()


@pytest.mark.parametrize("kind", ["full", "diag"])
def test_gmm_separates_and_improves(points, kind):
    model = gmm.fit(points, ["a", "b"], gmm.GMMParams(2, kind, max_iter=20))
    assert all(b >= a - 1e-9 for a, b in zip(model.history, model.history[1:], strict=False))
    assert sorted(np.round(model.means[:, 0]).tolist()) == [0.0, 6.0]
    scored = gmm.score(points, model)
    per = scored.groupBy((F.col("id") % 2).alias("k")).agg(F.countDistinct("gmm_component").alias("n")).collect()
    assert all(r.n == 1 for r in per)
    x = np.array(points.select("a", "b").collect())
    dens = sum(w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / (2 * math.pi * math.sqrt(np.linalg.det(c))) for w, m, c in zip(model.weights, model.means, model.covariances, strict=True))
    assert scored.agg(F.avg("gmm_loglik")).first()[0] == pytest.approx(float(np.log(dens).mean()))


def test_quantile_boost_coverage(spark):
    r = np.random.default_rng(2)
    rows = [(float(x), float(x + r.normal())) for x in r.uniform(0, 5, 400)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = quantile_boost.train(df, ["x"], "y", 0.9, n_estimators=12, max_depth=2, learning_rate=0.3)
    out = model.predict(df, "q").agg(metrics.coverage_rate("y", "q").alias("c"), metrics.pinball("y", "q", 0.9).alias("p")).first()
    flat = df.withColumn("q", F.lit(model.base)).agg(metrics.pinball("y", "q", 0.9)).first()[0]
    assert 0.84 < out.c < 0.96 and out.p < flat


def test_boosted_trees_score_as_mllib(spark):
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r.normal(size=2)), float(r.normal())) for i in range(300)], "id long, a double, b double, y double")
    model = quantile_boost.train(df, ["a", "b"], "y", 0.3, n_estimators=4, max_depth=3, learning_rate=0.5)
    rows = df.withColumn("want", F.lit(model.base))
    for tree, leaves in model.trees:
        placed = tree.setLeafCol("_leaf").setPredictionCol("_p").transform(quantile_boost.VectorAssembler(inputCols=["a", "b"], outputCol="_x").transform(rows))
        value = F.create_map(*[F.lit(v) for kv in leaves.items() for v in (float(kv[0]), kv[1])])
        rows = placed.withColumn("want", F.col("want") + 0.5 * F.element_at(value, F.col("_leaf"))).drop("_leaf", "_p", "_x")
    got = model.predict(rows, "got").collect()
    assert len(got) == 300 and all(x.got == pytest.approx(x.want) for x in got) and len({x.got for x in got}) > 8


def test_pca_against_eigenvectors(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0.2, 0.1]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = np.array([v.pca for v in explore.pca(df, ["a", "b", "c"]).orderBy("id").collect()])
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(centred.T))
    want = centred @ vectors[:, ::-1][:, :2]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8


def test_forest_scores(points):
    rows = points.withColumn("y", (F.col("id") % 2).cast("int"))
    model, scaler = forest.fit(rows, ["a", "b"], trees=5, depth=3)
    scored = forest.score(rows, model, scaler, ["a", "b"])
    assert scored.columns == [*rows.columns, "rf_proba_reversion"]
    assert metrics.roc_auc(scored, score="rf_proba_reversion").first().auc > 0.99
    assert [n for n, _ in forest.importances(model, ["a", "b"])][0] in ("a", "b")


def test_models_survive_saving(spark, points, tmp_path):
    rows = points.withColumn("y", (F.col("id") % 2).cast("int"))
    mixture = gmm.fit(points, ["a", "b"], gmm.GMMParams(2, max_iter=2))
    persist.save_mixture(spark, mixture, str(tmp_path / "m"), quantile=0.05)
    same = lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.collect()))
    assert same(gmm.score(points, mixture), gmm.score(points, persist.load_mixture(spark, str(tmp_path / "m"))))
    model, scaler = forest.fit(rows, ["a", "b"], trees=3, depth=2)
    persist.save_forest(spark, model, scaler, ["a", "b"], str(tmp_path / "f"))
    assert same(forest.score(rows, model, scaler, ["a", "b"]), forest.score(rows, *persist.load_forest(spark, str(tmp_path / "f"))))
    boost = quantile_boost.train(points, ["a"], "b", 0.5, n_estimators=2, max_depth=2)
    persist.save_boost(spark, boost, str(tmp_path / "b"))
    assert same(boost.predict(points, "q"), persist.load_boost(spark, str(tmp_path / "b")).predict(points, "q"))
    points.write.parquet(str(tmp_path / "t"))
    ticks.copy_table(spark, str(tmp_path / "t"), str(tmp_path / "t_copy"))
    assert same(points, spark.read.parquet(str(tmp_path / "t_copy")))


def test_finite_rows_and_scaler(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    kept = scaling.finite_rows(df, ["x"])
    assert scaling.fit_scaler(kept, ["x"]) == {"x": (2.0, 1.0)}
    assert sorted(r.x for r in scaling.scaled(kept, ["x"]).collect()) == [-1.0, 1.0]


def test_auc_of_one_class_is_null(spark):
    assert metrics.roc_auc(spark.createDataFrame([(1, 0.5)], "y int, proba double")).first().auc is None


BT = "id long, label int, rf_proba_reversion double, feat_vwap_zscore double, forward_return double, gbm_pred_q10 double, gbm_pred_q50 double, t timestamp_ntz"


@pytest.mark.parametrize("rows", [[], [(1, 1, 0.9, -1.0, 0.02, 0.0, 0.0)], [(1, 1, 0.9, None, 0.02, 0.0, 0.0), (2, 1, 0.9, 0.0, 0.02, 0.0, 0.0)], [(1, 1, 0.9, -1.0, 0.02, 0.0, 0.0), (2, -1, 0.9, 1.0, -0.01, 0.0, 0.0), (3, 0, 0.2, 1.0, 0.0, 0.0, 0.0)]])
def test_backtest_cases(spark, rows):
    t = dt.datetime(2025, 10, 8, 14)
    trades = backtest.simulate(spark.createDataFrame([(*r, t) for r in rows], BT))
    m = backtest.metrics(trades).first()
    wins, losses = [r[4] for r in rows if r[1] == 1 and r[2] >= 0.5], [r[4] for r in rows if r[1] == -1 and r[2] >= 0.5]
    assert (m.n_wins, m.n_losses) == (len(wins), len(losses))
    if wins and not losses:
        assert m.win_loss_ratio == math.inf
    if not rows:
        assert m.win_loss_ratio is None and m.hit_rate is None and m.sharpe is None
    if len(rows) == 2:
        assert m.sharpe is None  # no deviation
        assert {r.trade_direction for r in trades.collect()} == {-1}
    if len(rows) == 3:
        assert m.win_loss_ratio == pytest.approx(2.0) and m.n_trades == 2
    assert "| n_trades |" in backtest.metrics_table(m.asDict())
    assert backtest.html_table([{"a": "<b>"}]) == "<table><tr><th>a</th></tr><tr><td>&lt;b&gt;</td></tr></table>"
    assert backtest.rows_table([]) == ""


def test_ljung_box_tail_and_moments(spark):
    r = random.Random(4)
    x = [r.gauss(0, 1) for _ in range(80)]
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(x)], "k string, i long, v double")
    got = explore.ljung_box_10(df, "v", ("i",), ("k",)).first()
    m, n = sum(x) / 80, 80
    d = [v - m for v in x]
    q = n * (n + 2) * sum((sum(a * b for a, b in zip(d[k:], d, strict=False)) / sum(a * a for a in d)) ** 2 / (n - k) for k in range(1, 11))
    assert got.q == pytest.approx(q) and 0 < got.p_value < 1


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 10, 2, 13, 35)
    rows = [("A", t + dt.timedelta(seconds=i), 10.0 + i % 3, 4) for i in range(20)] + [("A", t + dt.timedelta(seconds=100), 10.0, 4)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, size long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(out, name, mode):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table(name).collect()

    flow = run(stream.tumbling_flow(source(), "10 seconds"), "flow", "append")
    assert sum(r.n_trades for r in flow) == 20
    made = sorted(run(stream.streaming_bars(source(), 10), "bars", "append"), key=lambda r: r.bar_id)
    assert [r.trade_count for r in made] == [3] * 7 and [r.bar_id for r in made] == list(range(7))

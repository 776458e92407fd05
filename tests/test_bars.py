"""Bars, features, volatility, labels and folds against plain Python."""

import datetime as dt
import math
import random
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.config import FeatureConfig, ProcessingConfig, config_hash, dump_config, load_config
from quantloom.operators import bars, cv, features, labels

T0 = dt.datetime(2025, 10, 2, 13, 35)
DAY = dt.date(2025, 10, 2)
TRADES = "ticker string, date date, ts timestamp_ntz, exch string, price double, size long, cond_norm string, event_id long"


def trades(spark, sizes, seed=0, ticker="A"):
    r = random.Random(seed)
    return [(ticker, DAY, T0 + dt.timedelta(seconds=i // 3), "N", round(100 + r.random(), 2), s, "", i) for i, s in enumerate(sizes)]


def loop_ids(sizes, threshold):
    out, total, bar = [], 0, 0
    for s in sizes:
        out.append(bar)
        total += s
        if total >= threshold:
            total, bar = 0, bar + 1
    return out


@pytest.mark.parametrize("sizes,threshold", [([9, 9, 9, 9], 10), ([10, 10], 10), ([50], 10), ([3, 3], 10), ([5, 5, 20, 1], 10)])
def test_segment_cases(spark, sizes, threshold):
    rows = trades(spark, sizes)
    rows.sort(key=lambda x: (x[2], x[3], x[4], x[5], x[6], x[7]))
    got = bars.segment_by_threshold(spark.createDataFrame(rows, TRADES), threshold).collect()
    assert {x.event_id: x.bar_id for x in got} == dict(zip([x[7] for x in rows], loop_ids([x[5] for x in rows], threshold), strict=True))


def test_segment_over_many_batches(spark):
    r = random.Random(2)
    rows = [x for t in "ABC" for x in trades(spark, [r.randint(1, 60) for _ in range(4000)], ord(t), t)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = bars.segment_by_threshold(spark.createDataFrame(rows, TRADES), 333).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for t in "ABC":
        own = sorted((x for x in rows if x[0] == t), key=lambda x: (x[2], x[3], x[4], x[5], x[6], x[7]))
        want = dict(zip([x[7] for x in own], loop_ids([x[5] for x in own], 333), strict=True))
        assert {x.event_id: x.bar_id for x in got if x.ticker == t} == want
        assert sum(x.bar_closed for x in got if x.ticker == t) in (max(want.values()), max(want.values()) + 1)


def test_generic_bars_of_scattered_rows(spark):
    """Rows of each part come from several tasks and are joined by the part's columns, as a large table is: its join is planned as
    sorted and turns out to be a broadcast, and its partitions aren't coalesced into one."""
    hard = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {c: spark.conf.get(c) for c in hard}
    i = F.col("id")
    rows = spark.range(0, 12_000, 1, 9).select(
        F.concat(F.lit("T"), i % 3).alias("ticker"), F.date_add(F.lit(DAY), (i % 2).cast("int")).alias("date"), F.timestamp_add("SECOND", (i / 6).cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("ts"),
        (100 + i * 7919 % 101 / 100.0).alias("price"), (1 + i * 104_729 % 60).alias("size"), i.alias("event_id"),
    )
    order = ("ts", "event_id")
    own = {}
    for x in sorted(rows.collect(), key=lambda x: x.event_id):
        own.setdefault((x.ticker, x.date), []).append(x)
    try:
        for c, v in hard.items():
            spark.conf.set(c, v)
        for measure in ("volume", "dollar"):
            got = {(b.ticker, b.date, b.bar_id): b for b in bars.generic_bars(rows, measure, 30, order).collect()}
            want = {}
            for part, xs in own.items():
                sizes = [x.size * (x.price if measure == "dollar" else 1) for x in xs]
                for x, b in zip(xs, loop_ids(sizes, sum(sizes) / 30), strict=True):
                    want.setdefault((*part, b), []).append(x)
            # The partial last bar of each part is dropped.
            assert len(own) == 6 and set(got) <= set(want) and len(want) - len(got) <= 6
            for k, b in got.items():
                assert (b.num_trades, b.volume, b.open, b.close) == (len(want[k]), sum(x.size for x in want[k]), want[k][0].price, want[k][-1].price)
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_running_sums_whatever_the_batches(spark):
    """The running sum of dollars is the same wherever batches end: 0.1 + 0.2 + 0.3 fills a bar of 0.6000000000000001, 0.1 + 0.5 doesn't."""
    rows = [("A", DAY, T0 + dt.timedelta(seconds=i), "N", p, 1, "", i) for i, p in enumerate([0.7, 0.1, 0.2, 0.3, 0.4])]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 2, 3, 5):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = bars.segment_by_threshold(spark.createDataFrame(rows, TRADES).coalesce(1), 0.6000000000000001, "price").orderBy("event_id").collect()
            assert [(x.bar_id, x.bar_closed) for x in got] == [(0, True), (1, False), (1, False), (1, True), (2, False)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_bar_invariants(spark):
    r = random.Random(3)
    rows = trades(spark, [r.randint(1, 40) for _ in range(500)])
    made = bars.volume_bars(spark.createDataFrame(rows, TRADES), 100).orderBy("bar_id").collect()
    assert sum(b.volume for b in made) == sum(x[5] for x in rows)
    for b in made:
        assert b.low <= min(b.open, b.close) and max(b.open, b.close) <= b.high and b.low <= b.vwap <= b.high
    assert all(b.volume >= 100 for b in made[:-1])
    v = bars.validate_bars(bars.with_duration(spark.createDataFrame(made))).first()
    assert v.is_valid and v.n_bars == len(made)
    assert bars.volume_bars(spark.createDataFrame([], TRADES), 100).count() == 0


def bar_rows(n, seed=0, constant=False, step=20):
    r, out, price, t = random.Random(seed), [], 100.0, T0
    for i in range(n):
        price = 100.0 if constant else price * (1 + r.gauss(0, 0.002))
        t += dt.timedelta(seconds=r.choice([0, step, 3 * step]))
        out.append(("A", DAY, i, t, t + dt.timedelta(seconds=r.choice([0, 5])), price * 1.0005, price * 1.001, price * 0.999, price, r.randint(10, 50), price * 1.0002, 3))
    return out


BARS = "ticker string, date date, bar_id long, t timestamp_ntz, t_end timestamp_ntz, open double, high double, low double, close double, volume long, vwap double, trade_count long"


@pytest.mark.parametrize("n,constant", [(1, False), (2, False), (21, True), (60, False)])
def test_features_against_loop(spark, n, constant):
    rows = bar_rows(n, n, constant)
    got = features.engineer_features(spark.createDataFrame(rows, BARS), FeatureConfig()).orderBy("bar_id").collect()
    near = lambda a, b: (a is None and b is None) or a == pytest.approx(b, rel=1e-7, abs=1e-9)
    for i, g in enumerate(got):
        prev, own = rows[max(0, i - 20) : i], rows[i]
        d = [x[8] - x[10] for x in prev]
        sd = st.stdev(d) if len(d) > 1 else 0
        if not constant:
            assert near(g.feat_vwap_zscore, (own[8] - own[10]) / sd if sd > 0 else 0.0)
            c = [x[8] for x in prev]
            w = 4 * st.stdev(c) if len(c) > 1 else 0
            assert near(g.feat_bollinger_position, max(-3, min(3, (own[8] - st.mean(c)) / (w / 2))) if w > 0 else 0.0)
        assert near(g.feat_momentum_3bar, own[8] / rows[i - 3][8] - 1 if i >= 3 else None)
        assert near(g.feat_relative_volume, own[9] / st.mean(x[9] for x in prev) if prev else 1.0)
        span = [x for x in rows if own[4] - dt.timedelta(minutes=5) <= x[4] < own[4]]
        assert g.feat_context_bar_count == len(span)
        assert near(g.feat_context_avg_volume, st.mean(x[9] for x in span) if span else float(own[9]))
        assert near(g.feat_context_price_range, (max(x[6] for x in span) - min(x[7] for x in span)) / own[8] if span else 0.0)
    assert features.validate_features(spark.createDataFrame(got, features.engineer_features(spark.createDataFrame(rows, BARS)).schema)).count() == 9


def ewm_loop(x, halflife):
    out = []
    for i in range(len(x)):
        known = [(v, 0.5 ** ((i - j) / halflife)) for j, v in enumerate(x[: i + 1]) if v is not None]
        if len(known) < 2:
            out.append(None)
            continue
        s0, q = sum(w for _, w in known), sum(w * w for _, w in known)
        m = sum(v * w for v, w in known) / s0
        out.append(math.sqrt(max(sum(w * (v - m) ** 2 for v, w in known) * s0 / (s0 * s0 - q), 0)))
    return out


@pytest.mark.parametrize("n,halflife", [(1, 50), (2, 50), (3, 50), (4, 50), (9, 50), (10, 50), (60, 50), (260, 0.5)])
def test_volatility(spark, n, halflife):
    rows = bar_rows(n, 7)
    got = [r.ewm_std for r in labels.barrier_volatility(spark.createDataFrame(rows, BARS), halflife).orderBy("bar_id").collect()]
    close = [x[8] for x in rows]
    ret = [None] + [b / a - 1 for a, b in zip(close, close[1:], strict=False)]
    want = [None, *ewm_loop(ret, halflife)[:-1]]
    want[0] = st.stdev(ret[1:10]) if n >= 10 else 0.01
    for i in range(len(want) - 2, -1, -1):
        want[i] = want[i + 1] if want[i] is None else want[i]
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-12))


def test_labels_against_loop(spark):
    rows = bar_rows(150, 9, step=60)
    df = labels.barrier_volatility(spark.createDataFrame(rows, BARS), 50)
    vol = {r.bar_id: r.ewm_std for r in df.collect()}
    seen = set()
    for k, minutes in ((1.0, 20), (3.0, 5)):
        for g in labels.triple_barrier(df, k, minutes).collect():
            i, p, v = g.bar_id, g.close, vol[g.bar_id]
            up, lo = (p * (1 + k * v), p * (1 - k * v)) if v and v > 0 else (p * 1.005, p * 0.995)
            limit, want = g.t_end + dt.timedelta(minutes=minutes), (0, "", None)
            for x in rows[i + 1 :]:
                if x[3] >= limit:
                    want = (0, "time", limit)
                elif x[6] >= up:
                    want = (1, "upper", x[3])
                elif x[7] <= lo:
                    want = (-1, "lower", x[3])
                else:
                    continue
                break
            assert (g.label, g.label_barrier_hit, g.label_t_end) == want
            assert g.label_holding_period_seconds == ((want[2] - g.t_end).total_seconds() if want[2] else 0.0)
            seen.add(want[1])
    assert seen == {"upper", "lower", "time", ""}


def test_first_hits_against_loop():
    r = np.random.default_rng(12)
    for n in (0, 1, 2, 3, 7, 64, 200):
        mid = 100 + np.cumsum(r.normal(0, 0.2, n))
        high, low, t = mid + r.random(n), mid - r.random(n), np.cumsum(r.integers(0, 3, n))
        up, down, until = mid + r.random(n) * 4, mid - r.random(n) * 4, t + r.integers(1, 60, n)
        want = [next((j for j in range(i + 1, n) if t[j] < until[i] and (high[j] >= up[i] or low[j] <= down[i])), -1) for i in range(n)]
        assert labels._first_hits(high, low, up, down, t, until).tolist() == want


def test_labels_over_batches(spark):
    """Bars that wait over several Arrow batches and parts get the labels of one batch."""
    rows = [(("A", "B", None)[p], *x[1:]) for p in range(3) for x in bar_rows(90, p, step=60)]
    df = labels.barrier_volatility(spark.createDataFrame(rows, BARS), 50)
    key = lambda out: sorted((str(x.ticker), x.bar_id, x.label, x.label_barrier_hit, str(x.label_t_end)) for x in out.collect())
    whole = key(labels.triple_barrier(df, 2.0, 15))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert key(labels.triple_barrier(df, 2.0, 15)) == whole and len(whole) == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert labels.triple_barrier(df.limit(0)).count() == 0


def test_fold_roles(spark):
    d1, d2 = dt.date(2025, 10, 1), dt.date(2025, 10, 2)
    m = lambda k: T0 + dt.timedelta(minutes=k)
    rows = [
        ("v1", d2, m(0), m(1), m(5)), ("v2", d2, m(8), m(9), m(10)),
        ("purged_into", d1, m(-5), m(-4), m(2)), ("purged_at_end", d1, m(10), m(11), m(12)), ("embargoed", d1, m(11), m(12), m(13)), ("embargoed_at_cutoff", d1, m(30), m(31), m(32)),
        ("train_after", d1, m(31), m(32), m(33)), ("train_before", d1, m(-9), m(-8), m(-7)), ("null_label", d1, m(-3), m(-1), None),
    ]
    df = spark.createDataFrame(rows, "id string, date date, t timestamp_ntz, t_end timestamp_ntz, label_t_end timestamp_ntz")
    roles = cv.fold_roles(df)
    got = {r.id: r.role for r in roles.filter("fold = 1").collect()}
    want = {"v1": "val", "v2": "val", "purged_into": "purged", "purged_at_end": "purged", "embargoed": "embargoed", "embargoed_at_cutoff": "embargoed", "train_after": "train", "train_before": "train", "null_label": "train"}
    assert got == want
    meta = {r.fold: r for r in cv.fold_metadata(roles).collect()}
    assert (meta[1].n_train, meta[1].n_val, meta[1].n_purged, meta[1].n_embargoed) == (3, 2, 2, 2)
    assert all(r.is_valid for r in cv.validate_folds(roles, ("id",)).collect())
    assert {r.split for r in cv.split_last_day(df).collect()} == {"train", "test"}


def test_config_round_trip(tmp_path):
    c = ProcessingConfig(thresholds={"A": 2000})
    out = dump_config(c, str(tmp_path / "c.yaml"))
    assert load_config(str(tmp_path / "c.yaml")) == c and out["config_hash"] == config_hash(c)

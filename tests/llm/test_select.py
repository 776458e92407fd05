"""Toxicity, quality rules, sharding, mixing and the pipeline."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import mixing, quality, sharding, toxicity
from quantloom.llm._common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def toxic_rows(n=900):
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        bad = i % 8 == 0
        w = r.choices(words, k=60)
        if bad:
            for k in r.sample(range(60), 4):
                w[k] = r.choice(["zorgul", "zorgulen", "ZORG0L", "vexnik***"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9002, "")], "doc_id bigint, text string").selectExpr("*", "1.0 as score", "0 as predicted")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    y = np.array([truth[g.doc_id] for g in held])
    assert auc(np.array([g.score for g in held]), y) > 0.97
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {g.doc_id for g in kept.collect()}
    assert ids == {g.doc_id for g in got if g.score < 0.5} and 9001 in ids


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1)]])
def test_toxicity_without_both_classes(spark, labels):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    got = toxicity.score_documents(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len({g.score for g in got}) == 1
    assert toxicity.score_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(1)
    x = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    xs, ys = toxicity.isotonic(x, y, np.ones(400))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    assert abs(np.interp(x, xs, ys).mean() - y.mean()) < 1e-9


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    r = random.Random(7)
    texts = ["", None, " ", "a", "a b", "a a a", "a a a a", "x y z x y z", "a\nb\na\n \na", "#*$%&|<> <", "ä😀 é b\x85c \x1cd", "\x0b\x0ca\rb\tc\n"]
    texts += ["".join(r.choices(["a", "b", "cc", " ", "\n", "#", "😀"], k=r.randint(0, 200))) for _ in range(60)] + ["w v u " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as n_words")
    got = {g.doc_id: (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in quality.count_features(df).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("mask", [0, 3 << 40])
def test_quality_counts_with_colliding_hashes(spark, mask):
    r = random.Random(17)
    texts = [" ".join(r.choices("abcdef", k=r.randint(0, 120))) for _ in range(60)] + [" ".join(f"w{i % 7001}" for i in range(20_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {g.doc_id: (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in quality.count_features(df, hash_mask=mask).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_binomial_tail(spark):
    for n, x, p in [(1, 0, 0.01), (500, 3, 0.01), (1000, 0, 0.01), (20000, 150, 0.01), (3000, 29, 0.01), (50, 10, 0.3), (4_000_000, 39_000, 0.01)]:
        got = spark.range(1).selectExpr(f"cast({n} as bigint) n", f"cast({x} as bigint) x").select(F.expr(quality.binomial_cdf("x", "n", p))).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(x + 1))
        assert got == pytest.approx(want, rel=1e-8)


def test_risk_is_controlled(spark):
    r = random.Random(8)
    rows, labels = [], []
    for i in range(6000):
        good = i % 6 != 0
        w = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for k in range(0 if good else 30):
            w[k] += "#" * 8
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(good)))
    rows += [(9000, "#" * 400 + " few", None), (9001, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'c' as kept")
    got = {g.doc_id: g for g in quality.judge_documents(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert sum(not got[i].kept for i, q in labels if q) / sum(q for _, q in labels) <= quality.RISK
    assert sum(not got[i].kept for i, q in labels if not q) > 900  # the cutoffs bite
    assert got[9000].base_failed and not got[9000].kept and not got[9001].kept
    none = quality.judge_documents(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert none.filter("kept").count() == 6000  # nothing proven, nothing rejected beyond the base rules
    assert quality.judge_documents(docs.limit(0), spark.createDataFrame(labels, "doc_id bigint, quality int")).count() == 0


def test_communication_matrix():
    sizes = [0, 1, 17, 400, 23]
    m = sharding.communication_matrix(sizes, 8, 1)
    assert [sum(row) for row in m] == sizes
    totals = [sum(c) for c in zip(*m, strict=True)]
    assert sum(totals) == sum(sizes) and max(totals) - min(totals) <= 1
    rng = np.random.default_rng(2)
    draws = [sharding.hypergeometric(rng, 2_000_000_000, 6_000_000_000, 1000) for _ in range(400)]
    assert abs(np.mean(draws) - 250) < 4 and 10 < np.std(draws) < 17


def test_shards(spark):
    rows = [(i % 900, "t" * (i % 7) if i % 11 else None) for i in range(1003)] + [(None, None)] * 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as slot").repartition(7)
    a = sharding.shard_documents(df, blocks=16, cells=4).collect()
    b = sharding.shard_documents(df.repartition(3), blocks=16, cells=4).collect()
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) == len(rows)
    for s in range(8):
        slots = sorted(r.slot for r in a if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (126, 127, 125)
    sizes = collections.Counter(r.shard for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    plain = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in rows]
    assert sorted(map(str, plain)) == sorted(str((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard)) for r in a)
    assert sharding.shard_documents(df.limit(0)).count() == 0
    own = sharding.shard_rows(df.selectExpr("doc_id", "text", "3 as shard", "'x' as Slot", "1 as _block", "2 as __rank"), ["doc_id", "text"])
    assert set(own.columns) == {"doc_id", "text", "_block", "__rank", "shard", "slot"} and own.agg(F.max("shard")).first()[0] == 7
    # Uniform: over seeds, each shard gets a row about equally often.
    few = spark.createDataFrame([(i, "x") for i in range(16)], "doc_id bigint, text string")
    hits = collections.Counter(r.shard for seed in range(24) for r in sharding.shard_documents(few, seed=seed, blocks=4, cells=2).collect() if r.doc_id == 3)
    assert max(hits.values()) <= 11


def waterfill(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, total = {}, set(names), sum(sizes.values())
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    return target


def mix_rows():
    r = random.Random(9)
    rows = [(i, r.choice(["b", "a", "z", "z", "z", "z", None, "é", "tiny"] if i > 3 else ["tiny"]), "w " * r.randint(0, 30)) for i in range(400)]
    return rows + [(900, "a", None), (901, "only empty", ""), (5, "z", "w w w"), (5, "z", "w w w")]


def test_mixing(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as taken", "2 as size")
    got = mixing.mix_report(df).collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = waterfill(sizes)
    source = {(i, len((t or "").split())): s for i, s, t in rows}
    taken = collections.Counter()
    for g in got:
        s = source[g.doc_id, g["size"]]
        assert g.source_size == sizes[s] and g.target == pytest.approx(target[s]) and 0 <= g.taken <= 3 * g["size"]
        taken[s] += g.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    made = mixing.mix_documents(df)
    assert made.columns == df.columns
    words = collections.Counter()
    for g in made.collect():
        words[g.source] += len(g.text.split())
    assert all(abs(words[s] - target[s]) <= 3 for s in sizes)
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, []
    for name, stage in cp.STAGES:
        out = cp.materialize(stage(spark, docs, sf), f"test-{name}")
        counts.append((name, docs.count(), out.count()))
        if name != cp.STAGES[-1][0]:
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            docs = out
    assert counts[1][1] == counts[1][2] and counts[2][2] <= counts[2][1] and counts[4][1] == counts[4][2]
    assert cp.run(spark, sf).count() == counts[-1][2]

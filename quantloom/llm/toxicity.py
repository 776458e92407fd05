"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Fitting uses a bounded sample of labelled rows (MOST_TOXIC, MOST_CLEAN, in hash order; never rows of the held-out
fifth). A lexicon is learnt from it: words and word beginnings, as log odds of document counts. So that the trees
don't see a lexicon fitted on their own rows, the sample has two halves and each half's features come from the
other half's lexicon. Features are lexicon densities, second-person words near lexicon words, capitals,
punctuation and obfuscation. The trees minimise logistic loss (Friedman 2001, histogram splits); their
out-of-fold raw scores give an isotonic map (pool adjacent violators), weighted back to the classes' true
shares. Counting and features run on the executors; the driver gets a bounded lexicon and the sample's features.

Scoring reads texts only: no label, language, source or id. It is narrow.

Defined cases: null and empty texts have no words and still get a score; repeated labels of a doc_id count
once (the highest); null labels are left out; of a labelled doc_id's several texts one is fitted on; without rows of both classes every score is the toxic share
of what labels there are (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import forget, map_rows, materialize, ship, text_or_empty

#: The bound of the sample that a model is fitted on.
MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: Entries that the model's lexicon may have (its size, as the number of trees), least document count of an entry, least odds ratio.
LEXICON, LEAST_COUNT, LEAST_ODDS = 3000, 3, 4.0
STRONG = 2.5  # log odds of a strong entry
BEGINNINGS = (3, 4, 5, 6, 7)
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, FOLDS = 100, 3, 0.1, 32, 1.0, 3
#: Second-person words (fixed list).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre vos usted ustedes ti tus vosotros".split())
_LEET = str.maketrans("013457@$", "oieastas")
_SIGNS = re.compile(r"[^\w]|_")
_INSIDE = re.compile(r"\w[*@$#%&!0-9]+[^\W\d]")
_LONG = re.compile(r"(.)\1\1")
NAMES = (
    "log_words", "strong_density", "weak_density", "log_strong", "log_weak", "log_strong_kinds", "top_weight", "weight_density", "second_person_near_hits",
    "second_person_density", "upper_share", "caps_words", "exclaim_rate", "punctuation_rate", "inner_signs_rate", "sign_tail_rate", "long_runs_rate", "obfuscated_hits",
)


def plain(word: str) -> str:
    """The word without signs, in lower case, digits and signs that stand for letters put back."""
    low = word.lower()
    bare = _SIGNS.sub("", low)
    return bare if bare.isalpha() else _SIGNS.sub("", low.rstrip("*@$#%&!|").translate(_LEET))


def entries(bare: str) -> list[str]:
    """The lexicon entries that a plain word can match: itself and its beginnings."""
    return ["=" + bare] + [bare[:n] for n in BEGINNINGS if len(bare) >= n]


def _word(word: str, lexicon: dict[str, float]) -> tuple:
    """What a word adds: weight, second person, upper-case letters, letters, all capitals, exclamations,
    other signs, signs inside, a tail of signs, long runs, hit only after deobfuscation."""
    bare = plain(word)
    weight = max((lexicon.get(e, 0.0) for e in entries(bare)), default=0.0) if bare else 0.0
    letters = sum(c.isalpha() for c in word)
    upper = sum(c.isupper() for c in word)
    signs = _SIGNS.findall(word)
    loud = sum(c in "!?" for c in signs)
    tail = len(word) - len(word.rstrip("*@$#%&|"))
    return weight, bare in SECOND_PERSON, upper, letters, letters > 1 and upper == letters, loud, len(signs) - loud, bool(_INSIDE.search(word)), tail > 1, bool(_LONG.search(word)), weight > 0 and bare != word.lower().strip(".,;:!?\"'()")


class Featurizer:
    LIMIT = 200_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.seen = lexicon, {}

    def _of(self, word: str) -> tuple:
        v = self.seen.get(word)
        if v is None:
            if len(self.seen) >= self.LIMIT:
                self.seen.clear()
            v = _word(word, self.lexicon)
            if len(word) <= 64:
                self.seen[word] = v
        return v

    def row(self, text: str) -> list[float]:
        words = text.split()
        n = len(words)
        if not n:
            return [0.0] * len(NAMES)
        strong = weak = kinds = near = second = upper = letters = caps = loud = signs = inside = tails = runs = hidden = 0
        top = total = 0.0
        hit_words = set()
        for w, k in Counter(words).items():
            v = self._of(w)
            if v[0]:
                hit_words.add(w)
                weak += k
                total += v[0] * k
                top = max(top, v[0])
                if v[0] >= STRONG:
                    strong += k
                    kinds += 1
            second += k * v[1]
            upper += k * v[2]
            letters += k * v[3]
            caps += k * v[4]
            loud += k * v[5]
            signs += k * v[6]
            inside += k * v[7]
            tails += k * v[8]
            runs += k * v[9]
            hidden += k * v[10]
        if hit_words and second:
            places = [(i, w in hit_words) for i, w in enumerate(words) if w in hit_words or self._of(w)[1]]
            for (i, a), (j, b) in zip(places, places[1:], strict=False):
                near += a != b and j - i <= 3
        return [
            np.log1p(n), strong / n, weak / n, np.log1p(strong), np.log1p(weak), np.log1p(kinds), top, total / n, near / n,
            second / n, upper / max(letters, 1), caps / n, loud / n, signs / n, inside / n, tails / n, runs / n, hidden / n,
        ]


# --- trees -----------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    share = min(max(float((w * y).sum() / w.sum()), 1e-4), 1 - 1e-4)
    model = Trees(base=float(np.log(share / (1 - share))))
    raw, flat = np.full(n, model.base), binned + np.arange(d) * BINS
    for _ in range(trees):
        p = sigmoid(raw)
        grad, hess = w * (y - p), w * p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, size = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (d * BINS) + flat).ravel()
            g, h = (np.bincount(place, np.repeat(a, d), size * d * BINS).reshape(size, d, BINS) for a in (grad, hess))
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < LEAST_HESSIAN) | (ht - hl < LEAST_HESSIAN)] = 0
            for k in range(size):
                j, b = np.unravel_index(int(gain[k].argmax()), (d, BINS))
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + 1)
        raw += value[leaf]
        model.feature.append(feature)
        model.threshold.append(threshold)
        model.value.append(value)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted isotonic fit of y on raw, by pooling adjacent violators."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least raw, greatest raw
    for r, v, k in zip(raw[order], y[order], w[order], strict=True):
        blocks.append([float(v), float(k), float(r), float(r)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    xs = np.array([x for b in blocks for x in (b[2], b[3])])
    return xs, np.array([b[0] for b in blocks for _ in (0, 1)])


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        # A thousandth of the raw score keeps the order inside the flat parts of the isotonic map.
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * sigmoid(raw)


# --- fitting ---------------------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, toxic, text of the sample (materialized), and how many labelled rows there are of either class. The ids
    are at most MOST_TOXIC + MOST_CLEAN, so they are broadcast and other texts aren't shuffled. A doc_id with several
    texts gives the one of least hash, so the sample has no more rows than ids."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter(~held_out())
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    order = (F.xxhash64(F.col("doc_id"), F.lit(42)), F.col("doc_id"))
    ids = known.filter("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    return materialize(rows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id"), "toxicity-sample"), counts


def _half(doc_id: int) -> int:
    return zlib.crc32(f"half {doc_id}".encode()) & 1


def _lexicon(found: DataFrame, halves: tuple[int, ...], totals: dict[tuple[int, int], int]) -> dict[str, float]:
    """Entries that favour toxic rows of these halves, with their log odds: the LEXICON ones that most toxic rows have."""
    n1, n0 = (sum(totals.get((h, c), 0) for h in halves) for c in (1, 0))
    pos, neg = (functools.reduce(Column.__add__, [F.col(f"n{h}{c}") for h in halves]) for c in (1, 0))
    odds = F.log((pos + 0.5) / (n1 + 1)) - F.log((neg + 0.5) / (n0 + 1))
    # An entry has to be certain enough too: half a standard error of the log odds is taken off.
    safe = odds - F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) * 0.5
    keep = found.select("entry", pos.alias("pos"), odds.alias("odds"), safe.alias("safe")).filter((F.col("pos") >= LEAST_COUNT) & (F.col("odds") >= float(np.log(LEAST_ODDS))) & (F.col("safe") > 0))
    return {r["entry"]: r["odds"] for r in keep.orderBy(F.desc("pos"), F.desc("safe"), "entry").limit(LEXICON).collect()}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    ship(docs.sparkSession)
    rows, counts = _sample(docs, labels)
    try:
        return _fitted(rows, counts)
    finally:
        forget(rows)


def _fitted(rows: DataFrame, counts: dict[int, int]) -> Model:
    total = sum(counts.values())
    if not counts.get(0) or not counts.get(1):
        return Model({}, None, None, counts.get(1, 0) / total if total else 0.0)

    def counting():
        def run(cols):
            seen: dict[str, list[int]] = {}
            for doc_id, toxic, text in zip(cols["doc_id"], cols["toxic"], cols["text"], strict=True):
                k = 2 * _half(doc_id) + toxic
                for e in {e for b in {plain(w) for w in set(text.split())} if b for e in entries(b)}:
                    seen.setdefault(e, [0, 0, 0, 0])[k] += 1
            return {"entry": list(seen), **{f"n{i // 2}{i % 2}": [v[i] for v in seen.values()] for i in range(4)}}

        return run

    both = [f"n{h}{c}" for h in (0, 1) for c in (0, 1)]
    found = map_rows(rows.select("doc_id", "toxic", "text"), counting, "entry string, n00 bigint, n01 bigint, n10 bigint, n11 bigint")
    found = materialize(found.groupBy("entry").agg(*[F.sum(c).alias(c) for c in both]).filter(F.col("n01") + F.col("n11") >= LEAST_COUNT), "toxicity-entries")
    sizes = {(r[0], r[1]): r[2] for r in map_rows(rows.select("doc_id", "toxic"), lambda: lambda c: {"half": [_half(i) for i in c["doc_id"]], "toxic": c["toxic"]}, "half int, toxic int").groupBy("half", "toxic").count().collect()}
    lexicons = {0: _lexicon(found, (1,), sizes), 1: _lexicon(found, (0,), sizes)}
    whole = _lexicon(found, (0, 1), sizes)
    forget(found)

    def measuring():
        makers = {h: Featurizer(lexicons[h]) for h in (0, 1)}
        return lambda cols: {"doc_id": cols["doc_id"], "toxic": cols["toxic"], "x": [[float(v) for v in makers[_half(i)].row(t)] for i, t in zip(cols["doc_id"], cols["text"], strict=True)]}

    got = map_rows(rows.select("doc_id", "toxic", "text"), measuring, "doc_id bigint, toxic int, x array<double>").toPandas().sort_values("doc_id")
    if got.empty or got["toxic"].nunique() < 2:
        return Model({}, None, None, counts[1] / total)
    x, y = np.array(got["x"].tolist()), got["toxic"].to_numpy(float)
    taken = Counter(got["toxic"])
    w = np.where(y == 1, counts[1] / taken[1], counts[0] / taken[0])
    w *= len(w) / w.sum()
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in got["doc_id"]])
    out = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and len(set(y[fold != k])) == 2:
            out[fold == k] = boost(x[fold != k], y[fold != k], w[fold != k]).raw(x[fold == k])
    return Model(whole, boost(x, y, w), isotonic(out, y, w), counts[1] / total)


# --- scoring ---------------------------------------------------------------------------------------------


def score(model: Model, text: str = "text") -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = Featurizer(model.lexicon)
        for texts in parts:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                out[at : at + 512] = model.scores(np.array([rows.row(t or "") for t in texts[at : at + 512]]))
            yield pd.Series(out)

    return scored(F.coalesce(F.col(text).cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    return own.select("doc_id", held_out().alias("held_out"), score(model).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model rejects, with the columns they had."""
    return docs.filter(score(fit(docs, labels)) < 0.5)

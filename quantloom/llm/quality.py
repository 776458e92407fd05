"""Quality rules with risk-controlled thresholds.

Every text gets counts (words, symbols, repeated lines, repeated three-word windows) and from them three
scores; higher is worse. A labelled good document that a cutoff rejects is a false rejection. For each stratum
(language) and score the least cutoff of a fixed grid is taken from which on every cutoff has an exact binomial
(Clopper-Pearson) test of "the false rejection rate is at least RISK / number of scores" rejected at level
CONFIDENCE_MISS / (strata x scores x cutoffs), Bonferroni's correction. So with probability
1 - CONFIDENCE_MISS no stratum loses more than RISK of its good documents to the cutoffs. Where the labels are
too few to prove any cutoff, none is used there.

The counts come from arrays inside a row, without exploding words: a window's hash and place share one long, so
sorting longs brings equal windows together. Neighbours of equal hash are compared word by word; a text in which
any two of them differ (or that has more words than a long's place can tell) has its windows sorted by their
words instead, so the counts are exact whatever the hash.

Defined cases: null and empty texts have no words and fail the base rules; a null language is a stratum;
labels of repeated doc_ids count once (the highest label); repeated rows give repeated results; an empty
table gives no rows, and without labels no cutoff is used. Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, SPACE_CLASS, materialize, text_or_empty

RISK, CONFIDENCE_MISS = 0.03, 0.05
SYMBOLS = "#*$%&|<>"
SCORES = ("symbol_share", "dup_line_share", "repeat_share")
#: Cutoffs of each score.
GRID = (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)
#: Low bits of a window's long that hold its place. Longer texts, and those with colliding hashes, sort the windows' words.
PLACE_BITS = 26
_PLACE = (1 << PLACE_BITS) - 1


def count_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), hash_mask: int = ~_PLACE) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of every text. hash_mask: the bits
    of a window's hash that are used; any number of them gives the same counts."""
    hash_mask &= ~_PLACE
    base = docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty().alias("_text"))
    base = base.withColumn("_trim", F.btrim("_text", F.lit(SPACE_CHARS)))
    base = base.withColumn("_w", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", f"[{SPACE_CLASS}]+")))
    base = base.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    base = base.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.col("_w"),
        F.when(F.size("_w") >= 3, F.expr(f"sort_array(transform(sequence(0, size(_w) - 3), i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & {hash_mask}L) | (i & {_PLACE}L)))")).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    # For each neighbour in that order: 0 another hash, 1 the same window, 2 the same hash of another window.
    place = lambda g: f"cast({g} & {_PLACE}L as int)"
    words = " and ".join(f"_w[{place('_g[i]')} + {k}] = _w[{place('_g[i - 1]')} + {k}]" for k in range(3))
    base = base.withColumn("_e", F.expr(f"if(size(_g) < 2, cast(array() as array<int>), transform(sequence(1, size(_g) - 1), i -> if(((_g[i] ^ _g[i - 1]) & {~_PLACE}L) != 0, 0, if({words}, 1, 2))))"))
    by_hash = f"transform(filter(_g, (x, i) -> (i > 0 and _e[i - 1] = 1) or (i < size(_e) and _e[i] = 1)), x -> {place('x')})"
    by_words = "transform(sequence(0, size(_w) - 3), i -> named_struct('a', _w[i], 'b', _w[i + 1], 'c', _w[i + 2], 'i', i))"
    same = "(g[{0}].a = g[{1}].a and g[{0}].b = g[{1}].b and g[{0}].c = g[{1}].c)"
    exact = f"flatten(transform(array(sort_array({by_words})), g -> transform(filter(g, (x, i) -> (i > 0 and {same.format('i', 'i - 1')}) or (i < size(g) - 1 and {same.format('i', 'i + 1')})), x -> x.i)))"
    base = base.withColumn("_at", F.expr(f"sort_array(if(array_contains(_e, 2) or size(_w) > {_PLACE}, {exact}, {by_hash}))"))
    covered = F.expr("aggregate(transform(_at, (p, i) -> cast(if(i < size(_at) - 1, least(3, _at[i + 1] - p), 3) as bigint)), 0L, (a, x) -> a + x)")
    return base.select(*[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_scores(features: DataFrame) -> DataFrame:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return features.withColumns({"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words")})


def _log_gamma(z: str) -> str:
    """ln Gamma(z), z >= 1, by Stirling's series at z + 8 (error under 1e-12)."""
    y = f"({z} + 8.0D)"
    series = f"1 / (12 * {y}) - 1 / (360 * pow({y}, 3)) + 1 / (1260 * pow({y}, 5)) - 1 / (1680 * pow({y}, 7))"
    product = " * ".join(f"({z} + {k}.0D)" for k in range(8))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.9189385332046727!r}D + {series} - ln({product}))"


def binomial_cdf(x: str, n: str, p: float) -> str:
    """SQL for P(Bin(n, p) <= x), x <= n * p. The term k steps below x is at most exp(-k * k / (2 * x)) of the one at
    x, so those left out, more than 40 roots of x below, are under exp(-800): exact in doubles for any n."""
    log_top = f"{_log_gamma(f'({n} + 1)')} - {_log_gamma(f'({x} + 1)')} - {_log_gamma(f'({n} - {x} + 1)')} + {x} * ln({p!r}D) + ({n} - {x}) * ln(1 - {p!r}D)"
    step = f"named_struct('t', a.t * k * {1 - p!r}D / (({n} - k + 1) * {p!r}D), 's', a.s + a.t * k * {1 - p!r}D / (({n} - k + 1) * {p!r}D))".replace("{1 - p!r}", repr(1 - p))
    down = f"aggregate(if({x} > 0, sequence({x}, greatest(1L, {x} - 40 * cast(ceil(sqrt({x})) as bigint) - 40), -1L), cast(array() as array<bigint>)), named_struct('t', 1.0D, 's', 1.0D), (a, k) -> {step}, a -> a.s)"
    return f"exp({log_top}) * {down}"


def risk_controlled_cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, miss: float = CONFIDENCE_MISS) -> DataFrame:
    """_stratum, score, cutoff: the least proven cutoff of each stratum and score; none where no cutoff is proven.
    scored: doc_id, stratum, SCORES and the counts; labels: doc_id, quality (1: good)."""
    good = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("_good")).filter("_good = 1").select("doc_id")
    held = scored.filter(~base_failed()).join(good, "doc_id", "left_semi")
    over = [F.count_if(F.col(s) > c).alias(f"{s}__{i}") for s in SCORES for i, c in enumerate(GRID)]
    counts = held.groupBy(_stratum(stratum).alias("_stratum")).agg(F.count("*").alias("_n"), *over)
    long = ", ".join(f"'{s}', {c!r}D, {s}__{i}" for s in SCORES for i, c in enumerate(GRID))
    tests = counts.crossJoin(counts.agg(F.count("*").alias("_strata"))).selectExpr("_stratum", "_n", "_strata", f"stack({len(SCORES) * len(GRID)}, {long}) as (score, cutoff, _x)")
    p = risk / len(SCORES)
    level = F.lit(miss) / (F.col("_strata") * len(SCORES) * len(GRID))
    proven = F.when(F.col("_x") < F.col("_n") * p, F.expr(binomial_cdf("_x", "_n", p)) <= level).otherwise(F.lit(False))
    return tests.withColumn("_proven", proven).groupBy("_stratum", "score").agg(F.max(F.when(~F.col("_proven"), F.col("cutoff"))).alias("_unproven"), F.collect_list(F.when(F.col("_proven"), F.col("cutoff"))).alias("_good")).select("_stratum", "score", F.array_min(F.filter("_good", lambda c: c > F.coalesce(F.col("_unproven"), F.lit(-1.0)))).alias("cutoff")).filter("cutoff is not null")


def _stratum(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def judge_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(stratum).cast("string").alias("_lang"), F.col("text"))
    features = with_scores(materialize(count_features(own, ("doc_id", "_lang")), "quality-features"))
    cutoffs = risk_controlled_cutoffs(features, labels, "_lang")
    wide = materialize(cutoffs.groupBy("_stratum").pivot("score", list(SCORES)).agg(F.min("cutoff")).select("_stratum", *[F.col(s).alias(f"_cut_{s}") for s in SCORES]), "quality-cutoffs")
    rejected = F.lit(False)
    for s in SCORES:
        rejected = rejected | F.coalesce(F.col(s) > F.col(f"_cut_{s}"), F.lit(False))
    out = features.withColumn("_stratum", _stratum("_lang")).join(wide, "_stratum", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))

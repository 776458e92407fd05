"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts.

Every document has a hash-random key. Within each source the keys are range-sorted: the key's first digits
give a bucket, prefix sums over the buckets' word counts give each bucket's offset, and only rows of one
bucket are sorted together, so a hot source is spread over as many tasks as its rows need. A source's budget in words is
its target; whole epochs are taken first and the last one is cut at the exact word.

Sources by code point, null last, weigh 1, 2, 3, repeating, and share 100 % of all words; a source's target
stops at MOST times its size and the excess goes to the others by weight. With the sources in order of
cap / weight, the water level is the largest of (total - caps before) / (weights from here on).

Defined cases: a null or empty text has 0 words and takes none; a null source is a source; repeated rows are
separate rows (fully equal ones share what the cut leaves); an empty table gives no rows.
Native: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, WORD_PATTERN, forget, materialize, text_or_empty

MOST, SEED = 3, 42
#: Least number of the key's first hexadecimal digits that make a bucket, and the rows that a bucket is for.
BUCKET_DIGITS, BUCKET_ROWS = 2, 1_000_000


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("bigint").alias("size"),
        _key(seed).alias("_key"),
    )


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, budget (whole words) of each source."""
    every = Window.partitionBy(F.lit(0))  # the sources alone, already summed
    order = every.orderBy(F.col("_ratio"), F.col("source").asc_nulls_last())
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_weight", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
        .withColumn("_cap", F.col("source_size") * MOST)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_caps", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_weights", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", F.max((F.col("_total") - F.col("_caps")) / F.col("_weights")).over(every))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.col("_level")))
        .select("source", "source_size", "target", F.least(F.col("_cap"), F.floor(F.col("target") + 0.5)).alias("budget"))
    )


def _placed(sized: DataFrame) -> DataFrame:
    """sized with source_size, target, budget and _before, the words before a row in its source's order."""
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(1, sized.count() / BUCKET_ROWS), 16)))
    sized = sized.withColumn("_bucket", F.substring("_key", 1, digits)).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    targets = source_targets(sized).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("_source", "_bucket").agg(F.sum("size").alias("_words")).select("_source", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    plan = offsets.join(targets, "_source")
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(plan, ["_source", "_bucket"]).withColumn("_before", F.col("_offset") + F.col("_inside"))


def _rest() -> Column:
    """Words of the last epoch that the budget leaves."""
    return F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(0)


def _epochs() -> Column:
    return F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    placed = _placed(materialize(_sized(docs, seed), "mix-sized"))
    taken = _epochs() * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), _rest() - F.col("_before")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of `docs`: a row for each time a document is taken; the one at the cut
    keeps its first words, joined by spaces. Texts aren't shuffled: each source's cut is a row of a small table.
    Rows with equal key and size at a cut share its words evenly."""
    columns = docs.columns
    sized = materialize(_sized(docs, seed), "mix-sized")
    placed = _placed(sized)
    at_cut = F.when((F.col("size") > 0) & (F.col("_before") + F.col("size") > _rest()), F.struct("_key", "size", F.greatest(F.lit(0), _rest() - F.col("_before")).alias("left")))
    cuts = materialize(placed.groupBy("_source").agg(F.max(_epochs()).alias("_epochs"), F.min(at_cut).alias("_cut")), "mix-cuts")
    ties = placed.join(cuts.select("_source", F.col("_cut._key").alias("_key"), F.col("_cut.size").alias("size")), ["_source", "_key", "size"], "left_semi").groupBy("_source").agg(F.count("*").alias("_ties"))
    plan = cuts.join(ties, "_source", "left").select("_source", F.col("_epochs").cast("int").alias("_epochs"), F.col("_cut._key").alias("_cut_key"), F.col("_cut.size").alias("_cut_size"), F.expr("_cut.left div coalesce(_ties, 1)").alias("_left"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"), F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("bigint").alias("_size"), _key(seed).alias("_key"))
    plan = materialize(plan, "mix-plan")
    forget(sized)
    forget(cuts)
    rows = rows.filter("_size > 0").join(plan, "_source")
    before = F.col("_cut_key").isNull() | (F.col("_key") < F.col("_cut_key")) | ((F.col("_key") == F.col("_cut_key")) & (F.col("_size") < F.col("_cut_size")))
    part = F.when(before, F.col("_size")).when((F.col("_key") == F.col("_cut_key")) & (F.col("_size") == F.col("_cut_size")), F.least("_left", "_size")).otherwise(F.lit(0))
    rows = rows.withColumn("_words", F.explode(F.concat(F.array_repeat("_size", F.col("_epochs")), F.array(part.cast("bigint"))))).filter("_words > 0")
    words = F.filter(F.split("_row.text", f"[{SPACE_CLASS}]+"), lambda w: w != "")
    text = F.when(F.col("_words") == F.col("_size"), F.col("_row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_words").cast("int")), " "))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])

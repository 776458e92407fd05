"""Line dedup by content-defined chunks of lines, at two scales.

Each line has a hash. Coarse chunks: a rolling hash over the last two lines' hashes ends a chunk where it is 0 modulo
MODULUS, so chunks inside a repeated passage have the same borders wherever the passage starts. Fine chunks: any
line with words up to the next one with words; they overlap, need no border, and cover passages too short to hold two
borders. A chunk has at least two lines with words. The lines of a chunk that occurs at an earlier place go (least
doc_id, then least text digest, then first line), except where it overlaps its first place in the same document; so
the first place of each line stays. Hashes of chunks meet first, with their places; only chunks whose
hash occurs again are taken from the texts. These meet by md5, and the bytes are compared as well: of all texts that
share a digest the least and the greatest must be the same, otherwise none of them is removed. Both aggregates have
one row for each different chunk in each task before the exchange, so a passage of a third of all documents is one row
of each task; the places are joined to them, which adaptive execution splits where a chunk is hot. Joins are by sorting
at every size: what a small table would broadcast grows with the documents.

Defined cases: null texts stay null and have no lines; an empty text is one line; rows with equal doc_id and
text count as one document and are treated alike; a doc_id may come with several texts; rows with a null doc_id are
compared like the others, null first; an empty table gives no rows; other columns pass through. Native: DataFrame and
SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CHARS, materialize, scratch

MODULUS, LEAST_LINES = 3, 2


def _worded(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS)) != ""


def _text_id() -> Column:
    """Tells texts of one doc_id apart; a whole digest where there is no doc_id."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.col("text").cast("binary"))).otherwise(F.hex(F.xxhash64("text")))


_LOW = 0xFFFFFFFF  # the half of a long that holds a chunk's last line


def _from(c: Column) -> Column:
    return F.shiftright(c, 32).cast("int")


def _to(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_LOW)).cast("int")


def _chunk(c: Column) -> Column:
    return F.array_join(F.slice("_lines", _from(c) + 1, _to(c) - _from(c) + 1), "\n")


def _chunk_places(docs: DataFrame, modulus: int) -> DataFrame:
    """doc_id, _doc, _c (first and last line from 0, in one long), _h (a hash of its text) of every chunk of both scales.
    Hashes are taken inside a row, so no row carries its document."""
    lines = docs.filter("text is not null").select("doc_id", _text_id().alias("_doc"), F.split("text", "\n").alias("_lines"))
    lines = lines.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: _worded(F.col("_lines")[i]))).filter(F.size("_at") >= LEAST_LINES)
    lines = lines.withColumn("_line_h", F.expr("transform(_lines, x -> cast(conv(substring(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))"))
    lines = lines.withColumn("_ends", F.expr(f"filter(sequence(0, size(_lines) - 1), i -> i = size(_lines) - 1 or (_line_h[i] * 31 + if(i > 0, _line_h[i - 1], 0L)) % {modulus} = 0)"))
    coarse = F.expr("transform(_ends, (e, k) -> shiftleft(cast(if(k > 0, _ends[k - 1] + 1, 0) as bigint), 32) | e)")
    coarse = F.filter(coarse, lambda c: F.size(F.filter(F.slice("_lines", _from(c) + 1, _to(c) - _from(c) + 1), _worded)) >= LEAST_LINES)
    fine = F.expr("transform(sequence(0, size(_at) - 2), k -> shiftleft(cast(_at[k] as bigint), 32) | _at[k + 1])")
    lines = lines.select("doc_id", "_doc", "_lines", F.array_distinct(F.concat(coarse, fine)).alias("_spans"))
    return lines.select("doc_id", "_doc", F.inline(F.transform("_spans", lambda c: F.struct(c.alias("_c"), F.xxhash64(_chunk(c)).alias("_h")))))


def _same_doc(a: str, b: str, c: str, d: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col(c) == F.col(d))


def _repeated_chunks(docs: DataFrame, modulus: int) -> DataFrame:
    """doc_id, _doc, _from, _to, _chunk of the chunks whose hash occurs again. Only hashes and places meet first; whole texts
    then go to the places found in them, once."""
    places = materialize(_chunk_places(docs, modulus), "line-places")
    again = places.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h")
    found = places.join(again.hint("merge"), "_h", "left_semi").groupBy(F.col("doc_id").alias("_id"), F.col("_doc").alias("_in")).agg(F.collect_set("_c").alias("_cs"))
    texts = docs.filter("text is not null").select("doc_id", _text_id().alias("_doc"), "text")
    rows = texts.join(found.hint("merge"), _same_doc("doc_id", "_id", "_doc", "_in")).select("doc_id", "_doc", "_cs", F.split("text", "\n").alias("_lines"))
    rows = rows.select("doc_id", "_doc", F.inline(F.transform("_cs", lambda c: F.struct(_from(c).alias("_from"), _to(c).alias("_to"), _chunk(c).alias("_chunk")))))
    return materialize(rows.withColumn("_digest", F.unhex(F.md5(F.col("_chunk").cast("binary")))), "line-chunks")


@scratch
def _removals(docs: DataFrame, modulus: int) -> DataFrame:
    """_id, _doc, _gone: the numbers of a document's lines that go."""
    place = F.struct(F.col("doc_id").alias("doc_id"), "_doc", "_from", "_to")
    rows = _repeated_chunks(docs, modulus)
    met = rows.groupBy("_digest").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.min("_chunk").alias("_least"), F.max("_chunk").alias("_most"))
    repeated = materialize(met.filter("_first != _last and _least = _most").select("_digest", "_first"), "line-repeats")
    later = rows.drop("_chunk").join(repeated.hint("merge"), "_digest").filter("not (doc_id <=> _first.doc_id and _doc = _first._doc and _from <= _first._to)")
    return materialize(later.groupBy(F.col("doc_id").alias("_id"), "_doc").agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(_from, _to)")))).alias("_gone")), "line-removals")


def dedup_lines(docs: DataFrame, modulus: int = MODULUS, report: bool = False) -> DataFrame:
    """docs with the lines of repeated chunks taken out of `text`. With report also n_lines, n_removed_lines and n_spans
    (runs of removed lines), which replace columns of these names."""
    gone = _removals(docs.select("doc_id", "text"), modulus)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _text_id().alias("_own"))
    out = own.join(gone.hint("merge"), _same_doc("_row.doc_id", "_id", "_own", "_doc"), "left").withColumn("_text", F.col("_row.text")).withColumn("_lines", F.split("_text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    text = F.when(F.col("_gone").isNull() | F.col("_text").isNull(), F.col("_text")).otherwise(kept)
    sorted_gone = F.array_sort(F.coalesce("_gone", F.array().cast("array<int>")))
    counts = {
        "n_lines": F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("bigint"),
        "n_removed_lines": F.size(F.coalesce("_gone", F.array().cast("array<int>"))).cast("bigint"),
        "n_spans": F.expr("size(filter(_sorted, (x, i) -> i = 0 or _sorted[i - 1] < x - 1))").cast("bigint"),
    }
    if report:
        out = out.withColumn("_sorted", sorted_gone)
    columns = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if not report or c.lower() not in counts]
    return out.select(*columns, *[v.alias(k) for k, v in counts.items()]) if report else out.select(*columns)


def report_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed_lines, n_spans, kept_sha256 of every document."""
    out = dedup_lines(docs.select("doc_id", "text"), report=True)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_lines", "n_removed_lines", "n_spans", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))

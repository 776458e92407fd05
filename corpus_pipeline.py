"""The corpus pipeline: toxicity, line dedup, near dedup, mixing to target weights, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the
shared folder and reads it again as the next stage's documents. All stages but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import bagminhash, linededup, mixing, piece_bpe, toxicity
from quantloom.llm._common import materialize, table


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """`columns`, with n_chars following the text where it is one of them."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labelled documents of this input."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated chunks go from the texts, so of any repeated passage of two or more lines; every document stays."""
    return _sized(linededup.dedup_lines(docs), docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id (null first)."""
    return bagminhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; those that it doesn't take go."""
    return _sized(mixing.mix_documents(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256."""
    return piece_bpe.encode_column(docs, ("doc_id", "lang", "source"), with_ids=True, digests=True)


STAGES = [("toxicity", reject_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can express neither the toxicity model nor the encoding; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

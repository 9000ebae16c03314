"""The corpus pipeline: toxicity, line dedup, near-duplicates, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is
written as Parquet and read again. All but the last return the columns of documents.

Defined cases: an empty table goes through all stages. A null text is never toxic, loses no passage, is like no
other, counts as no words, and has no tokens; an empty one likewise. Rows that repeat are judged alike by
toxicity, are one document to line dedup, and of those that repeat an id and text near-duplicates keep one. A
document without an id gives way to one that has one; it is drawn by its text. Ties go to the lesser id.
Further columns stay, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, linededup, mixing, neardup, toxicity
from graphloom.llm.common import checkpoint_dir, table
from graphloom.llm.queries import RANKS

SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first; a document of which nothing is left goes too.

    n_chars, where it is a column, is the length of the new text.
    """
    out = linededup.dedup(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(docs.columns)
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return neardup.drop_copies(docs, size=SHINGLE, percent=PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, beside the columns of documents without the text."""
    return bpe.encode(docs, bpe.rank_file(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN).drop("text")


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]

#: Toxicity and line dedup can't be told in SQL; tests/llm/test_brute.py holds each stage against a plain version of its rule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written to the shared folder and read again."""
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

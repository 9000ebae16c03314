"""Queries of the text operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bpe, contextmix, filteraudit, linededup, mixing, mpeg, neardup, oracles, pii, tokencount, toxicity, turns, urls, vafile
from graphloom.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"
MODEL = "piece_bpe_32k.model"


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextmix.scores(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.rank_file(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("th")


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.features(mpeg.store(table(spark, sf_dir, "documents")))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count(docs, tokencount.model_file(public_tokenizers.path(MODEL))).drop("text")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damaged(table(spark, sf_dir, "conversations")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_context_mixing, op2_mixing, op3_pii, op4_top_k, op5_line_dedup, op6_url_filter, op7_bpe, op8_toxicity, op9_near_duplicates, op10_mpeg_audio,
        op11_token_counts, op12_turn_repair, op13_filter_audit,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, htmltext, jaccard, licenses, merkle, mixing, prefixes, quotes, resampling, substrings, toxicity, warc
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.query(table(spark, folder, "documents"))


def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.query(table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.query(table(spark, folder, "pages"))


def op4_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.query(table(spark, folder, "documents"))


def op5_htmltext(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.query(table(spark, folder, "pages"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.query(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return bpe.query(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op8_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quotes.query(table(spark, folder, "conversations"))


def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.query(table(spark, folder, "embeddings"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.query(table(spark, folder, "documents"))


def op11_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.query(table(spark, folder, "conversations"))


def op12_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.query(table(spark, folder, "documents"))


def op13_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.query(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_merkle": op4_merkle,
    "op5_htmltext": op5_htmltext,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_quotes": op8_quotes,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_prefixes": op11_prefixes,
    "op12_licenses": op12_licenses,
    "op13_resampling": op13_resampling,
}
ORACLES: dict[str, str] = {
    "op1_substrings": substrings.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_merkle": merkle.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_prefixes": prefixes.ORACLE,
    "op12_licenses": licenses.ORACLE,
    "op13_resampling": resampling.ORACLE,
}

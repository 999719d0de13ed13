"""From raw documents to token ids: five stages, each calling one operator.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents of a folder. Each stage
reads the Parquet table that the one before it wrote.

Defined results, beyond those of the operators: a row without text is a clean document, has
no near duplicates but itself, and takes no part in the mix, whose words it lacks; the same
holds for an empty text. Of repeated rows the join keeps one. Rows without id are kept and
compared like others. An empty table passes all stages but the first as an empty one; the
first trains on labelled documents, and without any it rejects none. Columns beyond those
of ``documents`` go along unless a stage's result has their name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import bpe, jaccard, mixing, substrings, toxicity
from tillsight.llm.common import table, written
from tillsight.llm.queries import VOCABULARY


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    told = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return told.where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; what becomes empty by that goes."""
    cut = substrings.without_repeats(docs)
    kept = cut.where("removed_words = 0 or text rlike '[^ \\t\\r\\n]'")
    return kept.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(
        *[f"`{c}`" for c in docs.columns]
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, as rows of documents."""
    return mixing.copies(mixing.mixed(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, checked by decoding them again."""
    path = public_tokenizers.path(VOCABULARY)
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN, spaced=True)
    return bpe.digests(coded, docs.columns)


STAGES = [
    ("toxicity", clean),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_spans),
    ("mixing", mix),
    ("bpe", tokens),
]

#: A trained classifier is the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs

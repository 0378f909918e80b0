"""Corpus pipeline: five stages over ``documents``, each a corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Every stage takes nulls in any column (a null text counts as empty, a null source as a source, a null id as
no id), very long texts whole, repeated rows as rows, extra columns of whatever name as they are, and an empty
table, which stays empty. What is kept among ties is said in each stage's operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, exact_dedup, mixing, quality, simhash
from weftline.llm.common import drop_scratch, materialize, scratch_tables, table


#: The last model that was fitted on all documents, by the files that it was fitted on: a few hundred numbers.
_fitted: dict[tuple[str, ...], quality.Model | None] = {}


def classifier(spark: SparkSession, sf_dir: str) -> quality.Model | None:
    """The classifier of all documents; fitted once for both stages that use it, and anew if the files are others."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = (spark.sparkContext.applicationId, *sorted(docs.inputFiles()), *sorted(labels.inputFiles()))
    if key not in _fitted:
        model = quality.fit(docs, labels)
        _fitted.clear()
        _fitted[key] = model
    return _fitted[key]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    every = sorted(docs.inputFiles()) == sorted(table(spark, sf_dir, "documents").inputFiles())
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), model=classifier(spark, sf_dir) if every else None)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and selects documents so that every source comes near its target; the classifier's score is a document's quality weight.

    The classifier is that of all documents, as in the first stage: of those it kept, few labels are bad.
    """
    model = classifier(spark, sf_dir)
    return mixing.mixed_documents(docs, quality=None if model is None else quality.probabilities(model, docs)["score"])


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document of the mix, as digests."""
    return bpe.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_neardup", near_duplicates),
    ("source_mixing", source_mix),
    ("bpe", bpe_encoding),
]

#: The classifier, SimHash and BPE stages are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), scratch_tables()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_scratch(since, docs)  # the stage's input and its own tables
    return docs

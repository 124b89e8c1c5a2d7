"""From documents to padded training batches: toxicity, language, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the last,
which returns a slot in a batch for each document that stays. Rows with nulls are kept unless a
stage's decision concerns them: a null text isn't toxic, has no language and so goes at stage 2; without any row of a known language,
stage 2 keeps every text with a letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common, language_mixture, length_buckets, minmax_dedup, toxicity_grammar


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, fitted to the labels, doesn't predict to be toxic."""
    labels = common.table(spark, sf_dir, "labels")
    return toxicity_grammar.without_toxic(docs, toxicity_grammar.fit(docs, labels))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows name; if they name none, documents with a letter."""
    common.tune(spark)
    return language_mixture.with_language(docs, language_mixture.fit(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents linked by five-word shingles at a similarity of 0.8 or more, the row with the smallest id."""
    common.tune(spark)
    return minmax_dedup.one_of_each(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for each document."""
    common.tune(spark)
    return length_buckets.length_buckets(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", keep_known_languages),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("packing", pack),
]

#: SQL can't express the fitted stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written and read again. A stage's scratch tables go when it has been written, and its rows when the next stage has; the last stage's stay for the result."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = common.saved_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            common.drop(last)
        last = docs
    return docs

"""Nulls, empty and long texts, repeats, empty tables and clashing names: every operator gives a row where one is due."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from textloom.llm import class_ngrams, common, edit_counts, language_mixture, length_buckets, minmax_dedup, quality_forest, token_orc, toxicity_grammar, trie_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def tokens(docs):
    path = common.scratch_path(docs.sparkSession, "test-tokens")
    token_orc.write_tokens(docs, path, BYTES)
    return token_orc.checksums(token_orc.read_tokens(docs.sparkSession, path))


OPERATORS = {
    "op2": lambda docs, labels: class_ngrams.class_bigram_scores(docs),
    "op3": lambda docs, labels: edit_counts.edit_counts(docs, BYTES),
    "op4": toxicity_grammar.toxicity,
    "op5": lambda docs, labels: minmax_dedup.near_duplicates(docs),
    "op6": lambda docs, labels: tokens(docs),
    "op7": lambda docs, labels: length_buckets.length_buckets(docs, BYTES),
    "op8": quality_forest.quality_rules,
    "op9": lambda docs, labels: language_mixture.language_id(docs),
    "op10": lambda docs, labels: trie_bpe.encode_decode(docs, WORDS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each(spark, hard, labels, name):
    common.tune(spark)
    rows = OPERATORS[name](hard, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in hard.select("doc_id").collect())
    for r in rows:
        for column in ("score", "base_score", "n_tokens", "kept", "predicted", "lang_pred"):
            assert getattr(r, column, 0) is not None


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, nothing, labels, name):
    common.tune(spark)
    assert OPERATORS[name](nothing, labels.limit(0)).collect() == []


def test_stages_keep_columns(spark, hard, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    hard.write.parquet(str(tmp_path / "documents.parquet"))
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.saved(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == hard.columns, name
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(1) == 1 and 2 not in kept and 3 not in kept
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, kept))


def test_pipeline_on_nothing(spark, nothing, labels, tmp_path):
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_languages_nobody_names(spark, hard, labels, tmp_path):
    """Without a known language no text with a letter is lost."""
    docs = hard.withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.keep_known_languages(spark, docs, str(tmp_path))
    want = [r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert sorted(map(str, [r.doc_id for r in kept.collect()])) == sorted(map(str, want))


def test_one_id_in_most_rows(spark, labels):
    """An id repeated ten thousand times, with texts of its own: samples stay bounded, and every row comes out."""
    common.tune(spark)
    docs = spark.range(10_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("en").alias("lang"))
    for name in ("op4", "op5", "op8", "op9"):
        assert OPERATORS[name](docs, labels).count() == 10_000


def test_scratch_without_a_setting(spark, tmp_path):
    """A local session may name no shared folder; nothing is set for it. A cluster must."""

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = type("Context", (), {"master": master, "applicationId": master})()

    found = common.shared_dir(Session("local[2]"))
    assert found.startswith("file:///") and common.shared_dir(Session("local[2]")) == found
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session("spark://host:7077"))


def test_scratch_tables_go(spark, hard, labels):
    import os

    common.tune(spark)
    for name in OPERATORS:
        with common.scratch(spark) as paths:
            OPERATORS[name](hard, labels).collect()
        assert not any(os.path.exists(p.removeprefix("file:")) for p in paths), name


def test_scratch_is_in_the_shared_folder(spark):
    assert common.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    kept = common.saved(spark.range(3).withColumn("x", F.lit(1)), "x")
    assert kept.count() == 3

"""The kept dictionary of encodings: what is known isn't encoded again."""

from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe, corpus, dictionary

VOCABULARY = bpe.Vocabulary(T.BYTES, [bytes([b]) for b in range(256)] + [b"ab", b" ab"], {256: (97, 98), 257: (32, 256)})


def test_a_second_run_encodes_nothing(spark, tmp_path):
    rows = [(1, "ab ab abab é", 7), (1, "ab ab abab é", 7), (2, None, 7), (3, "", 7), (4, "x" * 200 + " ab", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    want = {1: sum(len(VOCABULARY.encode_chunk(c)) for c in ("ab", " ab", " abab", " é")), 2: None, 3: 0, 4: 201}
    for _ in range(2):
        found = dictionary.token_counts(df, VOCABULARY, str(tmp_path)).collect()
        assert sorted((r.doc_id, r.n_tokens, r.chunk) for r in found) == sorted((i, want[i], 7) for i, *_ in rows)
    path = dictionary.path_of(str(tmp_path), VOCABULARY)
    entries = dictionary.read(spark, path)
    assert {r.chunk: r.ids for r in entries.collect()} == {c: VOCABULARY.encode_chunk(c) for c in ("ab", " ab", " abab", " é", "x" * 200)}
    chunks = corpus.chunk_counts(df).select("chunk")
    assert dictionary.extend(chunks, VOCABULARY, path) == 0
    more = chunks.unionByName(spark.createDataFrame([("new",)], "chunk string"))
    assert dictionary.extend(more, VOCABULARY, path) == 1 and dictionary.read(spark, path).count() == 6


def test_another_vocabulary_has_another_dictionary(spark, tmp_path):
    other = VOCABULARY.with_specials(["<X>"])
    assert dictionary.path_of(str(tmp_path), other) != dictionary.path_of(str(tmp_path), VOCABULARY)
    df = spark.createDataFrame([(1, "<X>ab")], "doc_id long, text string")
    assert [dictionary.token_counts(df, v, str(tmp_path)).first().n_tokens for v in (VOCABULARY, other)] == [4, 2]
    assert dictionary.token_counts(df.limit(0), other, str(tmp_path)).select(F.col("n_tokens")).collect() == []


def test_texts_are_read_three_times(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(50).selectExpr("id as doc_id", "concat('ab ', id) as text").mapInArrow(counted, "doc_id long, text string")
    assert len(dictionary.token_counts(df, VOCABULARY, str(tmp_path)).collect()) == 50
    assert seen.value <= 150  # to count chunks, to look them up, and for the other columns

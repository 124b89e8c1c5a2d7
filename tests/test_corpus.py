import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe, corpus


def test_pretokens_with_specials(spark):
    text = "<BOS>Hello world.<BOS>Foo bar<BOS>Baz <BOS>q\n<BOS>z"
    found = spark.createDataFrame([(text,)], "text string").select(T.pretokens(F.col("text"), specials=("<BOS>",)).alias("c")).first().c
    assert found == ["<BOS>", "Hello", " world", ".<", "BOS", ">Foo", " bar", "<BOS>", "Baz", " <", "BOS", ">q", "\n", "<BOS>", "z"]


def test_pretokens_equal_byte_matching(spark):
    texts = ["snake_case  x", "é à l'été 1234", "naïve—dash…\n\n  x", "I'LL don't 'x", " a\t\tb", "日本語 text 🙂!", "", "trailing  ", "x²½ y"]
    raw = re.compile("|".join(T.ALTERNATIVES).encode())
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", T.pretokens(F.col("text")).alias("c")).collect()
    for r in rows:
        assert [c.encode() for c in r.c] == [m.group(0) for m in raw.finditer(texts[r.k].encode())], texts[r.k]


def test_mode_is_checked():
    with pytest.raises(ValueError):
        T.pattern("words")


def test_counts_without_specials_and_merge(spark):
    df = spark.createDataFrame([("<BOS>a b",), ("a b",), (None,)], "text string")
    counts = corpus.chunk_counts(df, specials=("<BOS>",))
    assert {r.chunk: r.cnt for r in counts.collect()} == {"a": 2, " b": 2}
    assert {r.chunk: r.cnt for r in corpus.merged_counts(counts, counts).collect()} == {"a": 4, " b": 4}


def test_score_filter(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "s double")
    assert [r.s for r in corpus.score_at_least(df, "s", 3.0).collect()] == [3.0]
    assert corpus.score_at_least(df, "s", None).count() == 4
    with pytest.raises(ValueError):
        corpus.score_at_least(df, "t", 1.0)


def test_training_by_hand(spark):
    counts = corpus.chunk_counts(spark.createDataFrame([("aaab aab ab",)], "text string"))
    v = bpe.train(counts, 264, ["<BOS>", "<PAD>"])
    assert v.merges == {256: (97, 97), 257: (97, 98), 258: (32, 256), 259: (32, 257), 260: (256, 257), 261: (258, 98)}
    assert (v.id_of("<BOS>"), v.id_of("<PAD>")) == (262, 263)
    assert [v.encode_chunk(c) for c in ("aaab", " aab", " ab", "aab")] == [[260], [261], [259], [256, 98]]


def test_training_equals_recounting(spark):
    words = {"banana": 5, "bandana": 3, "ananas": 2, "aaaa": 7, "nab": 1}
    counts = spark.createDataFrame(list(words.items()), "chunk string, cnt long")
    v = bpe.train(counts, 270, [])
    runs = {w: list(w.encode()) for w in words}
    for made in range(256, 256 + len(v.merges)):
        seen = {}
        for w, run in runs.items():
            for p in zip(run, run[1:]):
                seen[p] = seen.get(p, 0) + words[w]
        best = min(seen, key=lambda p: (-seen[p], p))
        assert v.merges[made] == best
        for w, run in runs.items():
            out, k = [], 0
            while k < len(run):
                joined = tuple(run[k : k + 2]) == best
                out.append(made if joined else run[k])
                k += 2 if joined else 1
            runs[w] = out


def test_text_mode_and_errors(spark):
    counts = spark.createDataFrame([("aé", 2)], "chunk string, cnt long")
    v = bpe.train(counts, 3, [], T.STR)
    assert v.tokens == ["a", "é", "aé"] and v.encode_chunk("aé") == [2]
    with pytest.raises(ValueError):
        v.encode_chunk("x")
    with pytest.raises(ValueError):
        bpe.train(counts, 10, [])


def test_encode_decode_nulls(spark):
    df = spark.createDataFrame([(1, "ab_c é", "x"), (2, None, None), (3, "", "y")], "doc_id long, text string, chunk string")
    v = bpe.train(corpus.chunk_counts(df), 260, ["<BOS>"])
    rows = bpe.decode(bpe.encode(df, v, bos="<BOS>"), v).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == ["<BOS>abc é", None, "<BOS>"]
    assert [r.chunk for r in rows] == ["x", None, "y"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n.1é", max_size=30))
def test_chunks_decode_to_the_text(text):
    v = bpe.Vocabulary(T.BYTES, [bytes([b]) for b in range(256)] + [b"ab", b" a"], {256: (97, 98), 257: (32, 97)})
    chunks = re.findall("|".join(T.ALTERNATIVES), text)
    assert v.decode([i for c in chunks for i in v.encode_chunk(c)]) == text


def test_extension_keeps_known_tokens():
    v = bpe.Vocabulary(T.BYTES, [b"a", b"b"], {}).with_specials(["<X>", "a", "<X>"])
    assert v.tokens == [b"a", b"b", b"<X>"] and v.specials == ["<X>"]


def test_batches_are_handled_in_slices():
    lists = [[1] * 5, None, [], [2] * 30, [3] * 4, [4] * 6, [5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.int32()))], ["k", "ids"])
    found = [x.column(1).to_pylist() for x in bpe._slices(iter([batch]), 1, 10)]
    assert [x for part in found for x in part] == lists
    assert all(len(part) == 1 or sum(len(x or ()) for x in part) <= 10 for part in found)

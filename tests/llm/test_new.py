"""Vector codes, token links and content sort against brute force, and their edge cases."""

import collections
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from textloom.llm import class_ngrams, common, content_sort, token_links, va_codes

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- content sort


def copies(rows):
    """(doc_id, keep_id, group_size, kept, digest) of rows (doc_id, text) in the order of the table."""
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for bare, own in groups.items():
        own.sort()
        keep = rows[own[0][3]][0]
        out += [(rows[k][0], keep, len(own), n == 0, hashlib.sha256(bare.encode()).hexdigest()) for n, (*_, k) in enumerate(own)]
    return sorted(out, key=str)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


COPIES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_copies_against_brute_force(spark, hard, nothing):
    rows = [(r.doc_id, r.text) for r in hard.coalesce(1).collect()]
    found = content_sort.exact_duplicates(hard.coalesce(1))
    assert sorted_rows(found, *COPIES) == copies(rows)
    assert content_sort.exact_duplicates(nothing).collect() == []


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_a_hot_group_over_many_ranges(spark, partitions):
    rng = random.Random(partitions)
    base = "the same long beginning of very many texts, longer than what splits them, " * 2
    rows = [(k, rng.choice([base, base + " ", base.replace(" ", "  "), base + "x", base + str(k), "", None])) for k in range(3000)]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        found = content_sort.exact_duplicates(df)
        assert sorted_rows(found, *COPIES) == copies(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- vector codes


def brute_codes(rows):
    """(vec_id, code, error, label_error, digest) with every entry compared, in whole numbers."""
    rows = sorted(rows, key=lambda r: r[0])
    whole = np.floor(np.array([v for _, v, _ in rows], float) * 1024).astype(np.int64).reshape(len(rows), 4, -1)
    books = whole[:256].transpose(1, 0, 2).copy()

    def assigned(k):
        gaps = ((whole[:, k, None, :] - books[k][None]) ** 2).sum(2)
        own = gaps.argmin(1)
        return own, gaps[np.arange(len(own)), own]

    for _ in range(4):
        for k, own in enumerate([assigned(k)[0] for k in range(4)]):
            for j in set(own.tolist()):
                books[k, j] = whole[own == j, k].sum(0) // (own == j).sum()
    found = [assigned(k) for k in range(4)]
    error = sum(x[1] for x in found)
    labels = collections.Counter()
    for (_, _, label), e in zip(rows, error.tolist()):
        labels[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return sorted(((i, "".join(f"{found[k][0][n]:02x}" for k in range(4)), int(error[n]), labels[label], digest) for n, (i, _, label) in enumerate(rows)), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_against_brute_force(spark, data):
    df = common.table(spark, data, "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted_rows(va_codes.vector_codes(df.repartition(7)), *CODES) == brute_codes(rows)


def test_codes_with_nulls_ties_and_few_rows(spark):
    rows = [(k, [k % 3 + 0.1, -k / 7, 0.0, 1e-3 * k, 2.0, -2.5, 3.0, k % 2 + 0.0], None if k % 4 == 0 else k % 2) for k in range(40)]
    bad = [(100, None, 1), (101, [1.0, None] * 4, 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, 1), (104, [1.0] * 5, 1)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, part int")
    rounded = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert sorted_rows(va_codes.vector_codes(df), *CODES) == brute_codes(rounded)
    again = va_codes.vector_codes(df.unionByName(df)).collect()
    assert len(again) == 80 and len({r.code for r in again if r.vec_id == 5}) == 1
    assert va_codes.vector_codes(df.limit(0)).collect() == []
    assert [r.error for r in va_codes.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")).collect()] == [0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(1, 4), st.integers(0, 10**6))
def test_bounds_hold_every_distance(entries, width, bits, seed):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-20, 20, (entries, width)), rng.integers(-30, 30, (15, width))
    cells = va_codes.Cells(book, bits)
    gaps = ((parts[:, None] - book[None]) ** 2).sum(2)
    near, far = cells.bounds(parts)
    assert (near <= gaps).all() and (gaps <= far).all()
    own, least, _ = cells.nearest(parts)
    assert (own == gaps.argmin(1)).all() and (least == gaps.min(1)).all()


# --- token links


TOKENIZER = Tokenizer.from_file(BYTES)
TOKENIZER.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
SIGNS = token_links._signs()
SPELLED = {i: bytes(SIGNS[c] for c in t) if all(c in SIGNS for c in t) else t.encode() for t, i in TOKENIZER.get_vocab().items()}


def piece(i):
    return bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode()


def brute_links(rows):
    documents, counts = [], collections.Counter()
    for i, t in rows:
        a, b = (TOKENIZER.encode(" " + t, add_special_tokens=False).ids, MODEL.encode(t)) if t else ([], [])
        sides = [[SPELLED[x] for x in a], [piece(x) for x in b]]
        if any(b"".join(s) != (" " + t).encode() for s in sides if t):
            a, b, sides = [], [], [[], []]
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in sides]
        groups, p, q = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            high = (ends[0].index(e) + 1, ends[1].index(e) + 1)
            groups.append((a[p : high[0]], b[q : high[1]]))
            p, q = high
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        documents.append((i, a, b, groups, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return sorted(((i, len(a), len(b), len(g), len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(text(g).encode()).hexdigest() if a else "") for i, a, b, g, ls in documents), key=str)


LINKS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
TEXTS = [None, "", " ", "a\0b c", "  x  y ", "<|endoftext|> hi<|endoftext|>", "a▁b c", "日本語 テキスト 🙂🙂 x", "\n\n a\tb \n", "ﬁ zﬁ　é é", "the the the", "<s> </s> <unk> <0x0A>", "x" * 3000, "​  q", "word  y", "a.b c-d e's f,g(h) i_j k~l 1.5 x.\ny.", "word\n other.\n\n- x", "été, ñ. ǅ. ж,ж. x².y"]


@pytest.mark.parametrize("head", [token_links.HEAD, 3, 0])
def test_links_against_brute_force(spark, head):
    rows = list(enumerate(TEXTS)) + [(None, "hello world"), (1, "hello world")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, links string")
    assert sorted_rows(token_links.token_links(df, BYTES, PIECES, head=head), *LINKS) == brute_links(rows)


def test_links_of_a_table(spark, data, hard, nothing):
    for df in (common.table(spark, data, "documents").repartition(3), hard):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted_rows(token_links.token_links(df, BYTES, PIECES), *LINKS) == brute_links(rows)
    assert token_links.token_links(nothing, BYTES, PIECES).collect() == []


def test_words_of_a_block_come_once_in_bounded_rows():
    """However many texts hold a word, a block has it once, and its words come in rows of bounded size before the texts."""
    words = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmnopqrstuvwx"]
    texts = [" ".join(words[k::7]) for k in range(7)] * 3
    own = token_links.Tokenizers(BYTES, PIECES)
    n = pa.array(range(len(texts)), pa.int64())
    of_words, of_texts = own.block(n, n, pa.array(texts))
    assert of_words.num_rows > 1 and of_texts.num_rows == len(texts)
    assert len(of_words.column("ends").flatten()) == len(set(words))
    assert of_texts.column("n_a").to_pylist() == [len(TOKENIZER.encode(" " + t, add_special_tokens=False).ids) for t in texts]


def test_tokenising_holds_no_object_for_each_word(monkeypatch):
    """What is remembered of words, and a block's words on their way, lie in arrays; a block's words are handed on a few rows at once."""
    words = [f"{a}{b}{c}{d}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd" for d in "efghijklmnopqrstuvwx"]
    own, n = token_links.Tokenizers(BYTES, PIECES), pa.array([0], pa.int64())
    tracemalloc.start()
    own.block(n, n, pa.array([" ".join(words * 2)]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60 * len(words) and len(own.known) == len(words)
    monkeypatch.setattr(token_links, "GIVEN", 1)
    texts = pa.RecordBatch.from_arrays([n, n, pa.array([" ".join(words * 2)])], ["row", "doc_id", "text"])
    *given, last = token_links._tokenise(BYTES, PIECES)(iter([texts]))
    assert last.num_rows == 1 and [b.num_rows for b in given] == [1, 1]


# --- what earlier operators gained


def test_class_scores_do_not_depend_on_the_layout(spark, data):
    """As many tasks as partitions, and blocks in another order: the same classes, so the same scores."""
    docs = common.table(spark, data, "documents")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    try:
        for parts, size in ((1, "1g"), (7, "64k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)  # blocks are read by one task, or by many
            found.append({r.doc_id: r.score for r in class_ngrams.class_bigram_scores(docs.repartition(parts)).collect()})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert found[0].keys() == found[1].keys()
    assert all(abs(x - found[1][i]) < 1e-6 * abs(x) for i, x in found[0].items())


def test_the_pipeline_leaves_its_result_alone(spark, data):
    import os

    base = common.shared_dir(spark).removeprefix("file://") + "/textloom"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    found = corpus_pipeline.run(spark, data)
    left = set(os.listdir(base)) - before
    assert len(left) == 1 and found.count() > 0

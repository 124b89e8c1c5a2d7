"""Operators against brute force, the library, or held-out rows."""

import cProfile
import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from textloom.llm import class_ngrams, common, edit_counts, language_mixture, length_buckets, minmax_dedup, quality_forest, queries, rotated_codes, token_orc, toxicity_grammar, trie_bpe

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, data):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect())


def query(spark, data, name):
    return {r.doc_id: r for r in entry.queries()[name](spark, data).collect()}


# --- nearest neighbours


def test_nearest_recall(spark, data):
    found = defaultdict(list)
    for r in entry.queries()["op1_rotated_codes"](spark, data).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    vectors, hit, total = {r.vec_id: np.array(r.embedding, float) for r in rows}, 0, 0
    assert set(found) == {i for i in vectors if i % 100 == 0}
    for q, near in found.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11))
        for _, i, score in near:
            assert score == pytest.approx(math.sqrt(((vectors[i] - vectors[q]) ** 2).sum()), abs=1e-12)
        best = sorted((math.sqrt(((v - vectors[q]) ** 2).sum()), i) for i, v in vectors.items() if i != q)[:10]
        hit, total = hit + len({i for _, i in best} & {i for _, i, _ in near}), total + 10
    assert hit >= 0.9 * total


def test_nearest_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    common.tune(spark)
    got = rotated_codes.nearest(df, F.col("id") == 0, 2).orderBy("query_id", "rank").collect()
    assert [(r["rank"], r.vec_id, r.score) for r in got[:2]] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert rotated_codes.nearest(df.limit(0), F.col("id") == 0).collect() == []


def clustered_vectors(kind):
    rng = np.random.default_rng(6)
    found = rng.standard_normal((30_000, 64))
    if kind == "clusters":
        found += 3 * rng.standard_normal((300, 64))[rng.integers(0, 300, len(found))]
    found[1:10_000:3] = found[5]  # one vector in many rows
    return found.astype(np.float32)


@pytest.mark.parametrize("kind", ["gauss", "clusters"])
def test_codes_find_neighbours(spark, tmp_path, kind):
    """Recall against brute force, and ties by id."""
    vectors = clustered_vectors(kind)
    table = pa.table({"vec_id": np.arange(len(vectors)), "embedding": pa.array(list(vectors)), "key": np.arange(len(vectors)), "v": np.arange(len(vectors))})
    pq.write_table(table, tmp_path / "e.parquet", row_group_size=4000)
    common.tune(spark)
    found, exact = defaultdict(list), vectors.astype(float)
    for r in rotated_codes.nearest(spark.read.parquet(str(tmp_path / "e.parquet")), F.col("id") % 100 == 0, 10).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    assert sorted(found) == list(range(0, len(vectors), 100))
    hit = 0
    for q, near in found.items():
        dist = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        dist[q] = np.inf
        near.sort()
        best = np.lexsort((np.arange(len(dist)), dist))[:10].tolist()
        hit += len(set(best) & {i for _, i in near})
        if dist[best[-1]] == 0:
            assert [i for _, i in near] == best
    assert hit >= 0.97 * 10 * len(found)


def test_codes_decide():
    """The bounds of packed codes hold nearly always, and leave out most rows where neighbours lie in clusters."""
    rng = np.random.default_rng(8)
    rows = rng.standard_normal((2000, 64)) + 3 * rng.standard_normal((30, 64))[rng.integers(0, 30, 2000)]
    center, turn = rows.mean(0), rotated_codes.rotation(64)
    codes, length, own = rotated_codes.encode(rows, center, turn)
    queries = rotated_codes.Queries(rows[:50], center, turn)
    least, greatest = queries.bounds(codes, length, own, slice(0, 50))
    exact = ((rows[:, None] - rows[None, :50]) ** 2).sum(2)
    assert ((least <= exact + 1e-6) & (exact <= greatest + 1e-6)).mean() > 0.98
    nearest = rotated_codes.Nearest(rows[:50], 11)
    ids = np.empty(len(rows), object)
    ids[:] = [[k] for k in range(len(rows))]
    nearest.add(queries, 0, ids, rows, codes, length, own)
    assert nearest.compared < 0.2 * 50 * len(rows)


def test_no_queries_and_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 7, 8) for i in range(1, 40)], "vec_id long, embedding array<double>, id int, list int")
    common.tune(spark)
    assert rotated_codes.nearest(df, F.col("id") == 0, 3).collect() == []
    assert [r.vec_id for r in rotated_codes.nearest(df, F.col("id") == 7, 3).orderBy("rank").collect()] == [6, 8, 5]


# --- class n-grams


def test_base_scores(spark, data, docs):
    out, counts, ends = query(spark, data, "op2_class_ngrams"), Counter(), 0
    for i, text in docs:
        if zlib.crc32(b"%d" % i) % 10:
            counts.update(WORD.findall(text.encode().lower()))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    base = model = 0.0
    for i, text in docs:
        words, r = WORD.findall(text.encode().lower()), out[i]
        want = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(counts[w] for w in words), ends])
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words) + 1, sum(w in counts for w in words) + 1, n, zlib.crc32(b"%d" % i) % 10 == 0)
        if r.held_out:
            base, model = base + r.base_score, model + r.score
    assert model > base


def test_scores_by_brute_force(spark, data, docs, monkeypatch):
    """Each text's transitions and emissions, one after the other, from the learned classes and steps."""
    kept, learned = [], class_ngrams.learned
    monkeypatch.setattr(class_ngrams, "learned", lambda *a: kept.append(learned(*a)) or kept[0])
    out, counts = query(spark, data, "op2_class_ngrams"), Counter()
    for i, text in docs:
        if zlib.crc32(b"%d" % i) % 10:
            counts.update(WORD.findall(text.encode().lower()))
    model, added, tokens, types = kept[0], class_ngrams.ADDED, defaultdict(int), defaultdict(int)
    for w, n in counts.items():
        tokens[model.class_of(w)] += n
        types[model.class_of(w)] += 1
    end = len(model.steps) - 1
    assert np.allclose((10**model.steps).sum(1), 1) and all(model.class_of(w) != end for w in counts)
    for i, text in docs[:60]:
        last, want = end, 0.0
        for w in WORD.findall(text.encode().lower()):
            own = model.class_of(w)
            want += model.steps[last, own] + math.log10((counts[w] + added) / (tokens[own] + added * (types[own] + 1)))
            last = own
        assert out[i].score == pytest.approx(want + model.steps[last, end], rel=1e-9)


def test_texts_become_symbols_once(spark, data, monkeypatch):
    """Tasks read texts twice, to count words and to code all documents: pairs, neighbours and scores come from the symbols."""
    docs = common.table(spark, data, "documents")
    read, run = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, *a, **k: read.append(df.columns) or run(df, *a, **k))
    class_ngrams.class_bigram_scores(docs)
    assert sum("text" in columns for columns in read) == 2 < len(read)


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    pairs = rng.integers(0, 5, (class_ngrams.SYMBOLS, class_ngrams.SYMBOLS)).astype(float)
    own = class_ngrams.exchange(pairs, sweeps=1)
    assert np.allclose((10 ** class_ngrams.transitions(pairs, own)).sum(1), 1)
    assert own[-1] == class_ngrams.CLASSES - 1 and (own[:-1] < class_ngrams.CLASSES - 1).all()


def likelihood(pairs, own, k):
    member = np.eye(k)[own]
    table = member.T @ pairs @ member
    f = class_ngrams._f
    return f(table).sum() - f(table.sum(0)).sum() - f(table.sum(1)).sum()


def test_exchange_reaches_a_local_best():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 9, (13, 13)).astype(float)
    own = class_ngrams.exchange(pairs, classes=4, sweeps=50)
    best = likelihood(pairs, own, 4)
    for w, c in itertools.product(range(12), range(3)):
        moved = own.copy()
        moved[w] = c
        assert likelihood(pairs, moved, 4) <= best + 1e-6


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    pairs, k = rng.integers(0, 4, (12, 12)).astype(float), 4
    own = rng.integers(0, k, 12)
    member = np.eye(k)[own]
    table = member.T @ pairs @ member
    both = np.diag(pairs)
    out, into = pairs @ member, pairs.T @ member
    out[np.arange(12), own] -= both
    into[np.arange(12), own] -= both
    gain = class_ngrams.gains(table, table.sum(1), table.sum(0), own, out, into, both)
    for w, c in itertools.product(range(12), range(k)):
        moved = own.copy()
        moved[w] = c
        assert gain[w, c] - gain[w, own[w]] == pytest.approx(likelihood(pairs, moved, k) - likelihood(pairs, own, k), abs=1e-6)


def test_words_outside_the_core_are_clustered(spark):
    """Words that end alike and are rarer than the core's: those between x and y differ from those between p and q, as frequent ones do."""
    rows = [f"{a} {kind}{n}{end} {b}" for kind, a, b in (("l", "x", "y"), ("r", "p", "q")) for end, words, times in (("often", 10, 100), ("same", 40, 5)) for n in range(words) for _ in range(times)]
    rows += [f"filler{n} " * 50 for n in range(class_ngrams.WORDS)]
    texts = spark.createDataFrame([(r,) for r in rows], "text string").repartition(3)
    counts = class_ngrams.word_counts(texts)
    model = class_ngrams.learned(texts, counts, sum(len(r.split()) for r in rows) + len(rows))
    left, right = ({model.class_of(f"{kind}{n}same".encode()) for n in range(40)} for kind in "lr")
    assert not left & right
    table = np.zeros_like(model.steps)
    for r in rows:
        own = [len(model.steps) - 1, *(model.class_of(w.encode()) for w in r.split()), len(model.steps) - 1]
        np.add.at(table, (own[:-1], own[1:]), 1)
    assert np.allclose(model.steps, class_ngrams.smoothed(table))


def test_vocabulary_and_classes_grow(spark, monkeypatch):
    monkeypatch.setattr(class_ngrams, "HEAD", 10)
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in range(n, n + 50)),) for n in range(0, 2000, 50)] * 2, "text string")
    counts = class_ngrams.word_counts(texts)
    assert len(class_ngrams.learned(texts, counts, 40_000).word) == 2000
    monkeypatch.setattr(class_ngrams, "PER_CLASS", 0.5)
    assert len(class_ngrams.learned(texts, counts, 40_000).steps) == 89


# --- edit-aware counts

BYTES_PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTER = edit_counts.Counter(BYTES_PATH)
UNTOUCHED = Tokenizer.from_file(BYTES_PATH)
EDITED = st.lists(st.sampled_from(["the", "in", " ", "  ", "\n", "\t", " \n", "'s", "'", "'l", "l", "é", "12", "½", "<|endoftext|>", "<|endof", "text|>", "|>", "漢", "🙂", "\u2003", "\x1c", "\x85", "!!", "_"]), max_size=30).map("".join)


def library_count(text):
    return len(UNTOUCHED.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(EDITED, st.integers(0, 40), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 8), EDITED), max_size=4))
def test_edits_equal_recounting(text, often, edits):
    text = text * often if len(text) * often < 400 else text
    tree = edit_counts.CountTree.of(text, COUNTER)
    for start, size, new in edits:
        tree.edit(start, start + size, new, COUNTER)
        start = min(start, len(text))
        text = text[:start] + new + text[start + size :]
        found, lengths, counts = tree.stored()
        assert (found, tree.n_chars, tree.n_tokens) == (text, len(text), library_count(text)) == (found, sum(lengths), sum(counts))
        assert list(lengths) == list(map(len, COUNTER.cut(text)))
        assert all(0 < len(x.lengths) <= edit_counts.LEAF for x in edit_counts.leaves(tree.tree))


def height_is_low(tree):
    return tree.tree.height <= 1.45 * math.log2(len(list(edit_counts.leaves(tree.tree))) + 1) + 1


def test_edits_touch_little():
    tree = edit_counts.CountTree.of("word " * 10_000, COUNTER)
    assert all(tree.edit(*e, COUNTER) <= 20 for e in ((25_000, 25_000, " [edited]"), (0, 20, ""), (40_000, 40_010, "\n\nend 123")))
    tree = edit_counts.CountTree.of("a b c", COUNTER)
    tree.edit(2, 2, "word " * 20_000, COUNTER)
    assert tree.edit(50_001, 50_002, "x", COUNTER) < 20 and height_is_low(tree)
    for k in range(500):
        assert tree.edit(1000 * (k % 90), 1000 * (k % 90) + 500, "new words ", COUNTER) < 40
    assert height_is_low(tree) and tree.n_tokens == library_count(tree.stored()[0])


def test_edit_query(spark, data, docs):
    out = query(spark, data, "op3_edit_counts")
    for i, text in docs:
        assert out[i].n_tokens == library_count(text)
        middle = len(text) // 2
        text = text[:middle] + " [edited]" + text[middle:]
        text = text[20:]
        text = text[: max(0, len(text) - 10)] + "\n\nend 123"
        assert (out[i].edited_chars, out[i].edited_tokens) == (len(text), library_count(text))


def test_stored_trees_follow_a_table_of_edits(spark):
    common.tune(spark)
    texts = {1: "one two three " * 50, 2: "", 3: None, 4: "untouched"}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    rows = [(1, 2, 0, 3, "ONE"), (1, 1, 14, 14, "<|endof"), (1, 3, 21, 21, "text|>"), (2, 1, 5, 9, "new"), (3, 1, 0, 0, "was null"), (None, 1, 0, 0, "x"), (9, 1, 0, 0, "x"), (1, 4, None, 0, "x"), (2, 2, 0, 1, None)]
    edits = spark.createDataFrame(rows, "doc_id long, seq int, start long, end long, text string")
    kept = common.saved(edit_counts.build_trees(docs, BYTES_PATH), "test-trees")
    kept = common.saved(edit_counts.apply_edits(kept, edits, BYTES_PATH).select("doc_id", "text", "lengths", "counts"), "test-trees")
    out = edit_counts.apply_edits(kept, edits.limit(0), BYTES_PATH).collect()
    want = {1: "ONE two three " + "<|endoftext|>" + texts[1][14:], 2: "ew", 3: "was null", 4: "untouched"}
    assert sorted((r.doc_id, r.text, r.n_tokens, r.n_reencoded) for r in out) == sorted((i, want[i], library_count(want[i]), 0) for i in (1, 1, 2, 3, 4))


# --- toxicity


def test_toxicity_held_out(spark):
    rng, words = random.Random(5), ["tree", "stone", "river", "cloud", "bread", "lamp", "house", "sheep"]
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            text[rng.randrange(30)] = rng.choice(["idiot", "zorgak", "zorgalen", "zorgamo"])
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(i % 3 == 0)))
    out = toxicity_grammar.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if common.remainder(r.doc_id, 5) == 0]
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in held) and all(0 <= r.score <= 1 for r in out)


def tags(text, stems=None):
    found = np.expm1(toxicity_grammar.Grammar(stems or {}).features(text)).round(6)
    return {t: n for t, n in zip(toxicity_grammar.TAGS, found) if n}


def test_grammar_tags():
    assert tags("What an IDIOT.") == {"plain": 1}
    assert tags("You idiot") == {"targeted": 1}
    assert tags("You are not, in any sense of the word, an idiot") == {"negated": 1}
    assert tags("You are not clever but an idiot") == {"targeted": 1}
    assert tags("He said: x. She said idiot") == {"reported": 1}
    assert tags("I will kill you") == {"threat": 1}
    assert tags("I will not kill you") == {"negated threat": 1}
    assert tags("He said I will kill you") == {"reported threat": 1}
    assert tags("te voy a matar") == {"threat": 1}
    assert tags("You. The idiots sing") == {"plain": 1}
    assert tags("semiidiot trashcan stupidity loserpool killjoy") == {}
    assert tags("zorgalen zorg zorgaaaaaaaaaaaaaa", {"zorga": 2.0}) == {"plain": 2}
    assert tags("你 idiot。you sing") == {"plain": 1}


def test_negation_and_report_lower_the_score():
    grammar = toxicity_grammar.Grammar({})
    assert tags("te voy a matar: nada") == {"threat": 1}
    score = lambda text: grammar.score(grammar.features(text))
    for plain in ("I will kill you", "you idiot"):
        assert score(plain) > score("he said " + plain) and score(plain) > score("not " + plain)


def test_grammar_of_reports_and_quotes():
    assert tags("He wrote: you idiot") == {"reported": 1}
    assert tags("The rule: you idiot") == {"targeted": 1}
    assert tags("You know what: idiot") == {"plain": 1}
    assert tags("I can not: an idiot") == {"plain": 1}
    assert tags('She said "you idiot"') == tags("She said: “you idiot”") == tags("Er sagte: „du idiot“") == {"reported": 1}
    assert tags('She said "well. Now then! You idiot." and left') == {"reported": 1}
    assert tags('She said "hello", you idiot') == {"targeted": 1}
    assert tags('She said "hello." You idiot.') == {"targeted": 1}
    assert tags('She said. "You idiot"') == {"targeted": 1}
    assert tags('She said "hello\nYou idiot"') == {"targeted": 1}
    assert tags('He wrote: "I will kill you"') == {"reported threat": 1}
    assert tags("He said you are not an idiot") == {"reported negated": 1}
    assert tags("He said: I will not kill you") == {"reported negated threat": 1}
    assert tags("idiot, you") == tags("idiot you") == {"plain": 1, "targeted": 1}
    assert tags("idiot saw you") == tags("idiot. You") == {"plain": 1}
    assert tags("zorg, you", {"zorg": 0.5}) == {"plain": 0.5, "targeted": 0.5}
    assert tags("You idiot, you") == {"targeted": 1}
    grammar = toxicity_grammar.Grammar({})
    score = lambda text: grammar.score(grammar.features(text))
    assert score("you idiot") > score("he wrote: you idiot") and score('he said "x", you idiot') > score('he said "you idiot"')
    assert score("idiot, you") > score("idiot")


def in_place(text):
    """Reported or not, by hand: the verb's clause up to its end, or the quotation that opens in it, whatever ends clauses there."""
    out, said, inside = [], False, False
    for x in text:
        if x == "r":
            said = True
        elif x == "q":
            said, inside = (False, False) if inside else (said, said)
        elif x == "e":
            said = said and inside
        elif x == "i":
            out.append(said)
    return out


@given(st.lists(st.sampled_from("wriqke"), max_size=12))
def test_reports_against_brute_force(kinds):
    signs = dict(w="tree", r="said", i="idiot", q='"', k=":", e=".")
    found = tags(" ".join(signs[x] for x in kinds))
    want = in_place(kinds)
    assert found.get("reported", 0) == sum(want) and found.get("plain", 0) == len(want) - sum(want)


@given(st.lists(st.sampled_from(toxicity_grammar.KINDS), max_size=9))
def test_composition_equals_the_cascade(kinds):
    """One after the other, with weights multiplied along each symbol, against the composed transducer."""
    rows = [(x, 1.0) for x in kinds]
    for one in (toxicity_grammar.THREAT, toxicity_grammar.NEGATION, toxicity_grammar.REPORT, toxicity_grammar.TARGET, toxicity_grammar.INSULT):
        state, out = 0, []
        for x, weight in rows:
            state, y, own = one.arc(state, x)
            if y:
                out.append((y, weight * own))
        rows = out
    assert toxicity_grammar.CLAUSE.read(kinds) == rows


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.5), ("sf0.1", 0.75)])
def test_toxicity_query(spark, sf, recall):
    """Held-out rows: most of what is labelled toxic is found, and hardly anything else."""
    out = entry.queries()["op4_toxicity_grammar"](spark, f"/root/testdata/{sf}").where("held_out")
    rows = out.join(spark.read.parquet(f"/root/testdata/{sf}/labels.parquet"), "doc_id").where("toxic is not null").collect()
    right = sum(r.predicted and r.toxic for r in rows)
    assert right >= recall * sum(r.toxic for r in rows) and right >= 0.95 * sum(r.predicted for r in rows)


# --- near-duplicates


def components(sets, percent):
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in sets}


def shingle_set(text, width):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def test_near_duplicates(spark, data, docs):
    out = query(spark, data, "op5_minmax_dedup")
    sets = {i: shingle_set(text, 3) for i, text in docs}
    want = components(sets, 85)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in out.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, data, name):
    found = duckdb.execute(queries.ORACLE_SQL[name].replace("FROM documents", f"FROM read_parquet('{data}/documents.parquet')"))
    columns = [x[0] for x in found.description]
    rows = entry.queries()[name](spark, data)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(found.fetchall())


def test_chains_and_groups(spark):
    """A group of edited copies, links that only a chain makes, and texts that share one long passage."""
    rng, rows = random.Random(9), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(120)]
    for i in range(120):
        text = list(base)
        for _ in range(i % 9):
            text[rng.randrange(120)] = word()
        rows.append((i, " ".join(text)))
    passage = [word() for _ in range(60)]
    rows += [(200 + k, " ".join(passage + [word() for _ in range(40)])) for k in range(60)]
    sliding = [word() for _ in range(300)]
    rows += [(300 + k, " ".join(sliding[4 * k : 4 * k + 100])) for k in range(40)]
    out = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert out == components({i: shingle_set(t, 3) for i, t in rows}, 85)


def test_equal_differences_make_few_pairs(spark, monkeypatch):
    """Texts that differ from one template in two words each, mostly under the threshold: pairs that reach the texts grow with the links."""
    rng, seen = random.Random(3), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    rows = []
    base = [word() for _ in range(100)]
    for i in range(400):
        text = list(base)
        for k in rng.sample(range(100), 2):
            text[k] = word()
        rows.append((i, " ".join(text)))
    confirmed = minmax_dedup.confirmed
    monkeypatch.setattr(minmax_dedup, "confirmed", lambda pairs, *a: seen.append(pairs.count()) or confirmed(pairs, *a))
    common.tune(spark)
    out = {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert out == components({i: shingle_set(t, 3) for i, t in rows}, 85) and sum(seen) < 4 * len(rows)


def test_repeated_and_null_ids(spark):
    """Rows of one id with unlike texts are judged by their own; of rows without an id one stays."""
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(7, one), (7, two), (3, two + " x"), (None, one), (None, "c d e"), (None, "c d e"), (None, None), (8, None)]
    common.tune(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minmax_dedup.near_duplicates(docs, width=3, percent=85).collect())
    assert [x for x in out if x[0] == "7"] == [("7", 58, "3", False), ("7", 58, "7", True)]
    assert sum(kept for i, n, _, kept in out if i == "None" and n) == 1
    kept = sorted(str((r.doc_id, (r.text or "")[:3])) for r in minmax_dedup.one_of_each(docs, width=3, percent=85).collect())
    assert kept == sorted(str(x) for x in [(7, "a0 "), (3, "b0 "), (None, "c d"), (None, ""), (8, "")])


@given(st.lists(st.integers(0, 2**63), max_size=300), st.lists(st.integers(0, 2**63), max_size=300))
def test_sketches_lose_no_link(a, b):
    a, b = (np.unique(np.array(x, np.uint64)) for x in (a, b))
    one, two = minmax_dedup.odd_sketch(a), minmax_dedup.odd_sketch(b)
    size = min(len(one), len(two))
    x, y = minmax_dedup.folded([one, two], size)
    assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_near_duplicates_at_a_larger_size(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: shingle_set(r.text, 3) for r in rows}
    out = query(spark, "/root/testdata/sf0.01", "op5_minmax_dedup")
    assert {i: r.component_id for i, r in out.items()} == components(sets, 85)


def test_bands_rarely_miss():
    for similarity in (0.8, 0.85):
        r = minmax_dedup.rows_per_band(similarity)
        assert (1 - similarity**r) ** (minmax_dedup.VALUES // r) <= minmax_dedup.MISS


# --- token files


def test_token_files(spark, data, docs):
    tokenizer, out, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), query(spark, data, "op6_token_orc"), 0
    for i, text in docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (out[i].start, out[i].n_tokens, out[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_filters_reach_the_files(spark, data):
    path = common.scratch_path(spark, "test-tokens")
    token_orc.write_tokens(common.table(spark, data, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_orc.read_tokens(spark, path).where("doc_id = 17")
    assert "EqualTo(doc_id,17)" in found._jdf.queryExecution().toString() and found.count() == 1


def rows_scanned(df):
    """Rows that the file scan of a plan without shuffles gave."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return node.metrics().apply("numOutputRows").value()


def test_readers_skip_and_share_stripes(spark, monkeypatch):
    """Even ids only: a filter on one reads few rows of many, by the row indexes; one on an odd id, which the ranges don't exclude, hardly any, by the Bloom filters."""
    monkeypatch.setattr(token_orc, "STRIPE", 1 << 16)
    common.tune(spark)
    path, n = common.scratch_path(spark, "test-stripes"), 60_000
    docs = spark.range(n).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") + n).cast("string"), 256)).alias("text"))
    token_orc.write_tokens(docs, path, BYTES_PATH)
    files = spark.read.schema(token_orc.SCHEMA).orc(path).select("doc_id", "n_tokens")
    assert rows_scanned(files.where("doc_id = 50000")) <= 3000
    assert sum(rows_scanned(files.where(f"doc_id = {k}")) for k in range(50_001, 50_021, 2)) <= 3000
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        parts = spark.read.schema(token_orc.SCHEMA).orc(path)
        assert parts.rdd.getNumPartitions() > len(parts.inputFiles()) and parts.count() == n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


PIECES = st.lists(st.sampled_from(["the", "in", " ", "  ", "\n", "\t", "\r\n", "'s", "'LL", "é", "é", "ß", "Σ", "İ", "ǅ", "12", "½", "<|endoftext|>", "<|startoftext|>", "<|", "漢", "🙂", " ", " ", "\x1c", "\x85", "!!", "_", "zxq", "한", "ﬁ"]), max_size=20)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_encoder_equals_the_library(parts):
    texts = ["".join(p) for p in parts]
    encoder = token_orc.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array([*texts, None])
    ids, ends = encoder.encode(column.slice(0), np.array([7], np.int32).tobytes())
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [*(x + [7] for x in want), [7]]
    assert encoder.sizes(column.slice(1)).tolist() == [*map(len, want[1:]), 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abzÉж\u0561漢2½", max_size=4), st.text(".,;:!?'\"#_$\u2026", max_size=5)), max_size=12))
def test_stops_after_words_equal_the_library(words):
    texts = ["x " + " ".join(w + s for w, s in words), "x don't, it's. we're! 'tis 's"]
    encoder = token_orc.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, ends = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want


def test_encoder_works_by_batches():
    """Distinct words are looked up, cut and learned in arrays: calls don't grow with words, and what few batches hold is forgotten first."""
    encoder, profile = token_orc.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1000), cProfile.Profile()
    texts = [pa.array(["x " + " ".join(f"{w}{'a' * (k % 7)}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}," for k in range(5000)) + " often"]) for w in ("one", "two", "three")]
    profile.enable()
    found = [encoder.encode(t)[0].tolist() for t in texts]
    profile.disable()
    assert found == [encoder.tokenizer.encode(t[0].as_py(), add_special_tokens=False).ids for t in texts]
    assert sum(x.callcount for x in profile.getstats()) < 5000
    encoder.encode(pa.array(["x y"]))
    assert len(encoder.known) <= 501 and "often" in encoder.known.to_pylist()


TRIE = trie_bpe.load(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4), st.text(alphabet="abcdefghijklmnopqrstuvwxyz", max_size=40))
def test_trie_equals_the_library(parts, word):
    texts = [*("".join(p) for p in parts), word]
    for text, (ids, decoded) in zip(texts, TRIE.encode(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


def test_trie_query(spark, data, docs):
    out = query(spark, data, "op10_trie_bpe")
    for i, text in docs:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == want


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 20), min_size=1, max_size=7), st.integers(1, 8))
def test_boundaries_are_best(histogram, k):
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[x] for x in sorted(histogram)])
    total = lambda ends: sum(n * min(e for e in ends if e >= x) for x, n in histogram.items())
    found = length_buckets.best_boundaries(lengths, counts, k)
    every = (set(some) | {lengths[-1]} for r in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1], r))
    assert len(found) <= k and total(found) == min(map(total, every))


def test_batches(spark, data, docs):
    rows = entry.queries()["op7_length_buckets"](spark, data).collect()
    batches = defaultdict(list)
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches[r.bucket_len, r.batch].append(r)
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library_count(t) + 1 for i, t in docs}
    lengths = sorted(library_count(t) + 1 for _, t in docs)
    ends = length_buckets.best_boundaries(*np.unique(lengths, return_counts=True))
    assert sum(r.bucket_len for r in rows) == sum(min(e for e in ends if e >= n) for n in lengths)
    for (size, batch), own in batches.items():
        assert len(own) * size <= length_buckets.BUDGET or len(own) == 1
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert [r.doc_id for r in sorted(own, key=lambda r: r.slot)] == sorted(r.doc_id for r in own)
    for size in {r.bucket_len for r in rows}:
        seen = sorted(b for s, b in batches if s == size)
        assert seen == list(range(len(seen)))
        assert all(len(batches[size, b]) == max(1, length_buckets.BUDGET // size) for b in seen[:-1])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20_000), min_size=1, max_size=300), st.integers(1, 16))
def test_long_lengths_are_exact(sizes, k):
    """Against the quadratic program over all lengths."""
    lengths, counts = np.unique(sizes, return_counts=True)
    running = np.concatenate([[0], np.cumsum(counts)])
    best = np.concatenate([[0], lengths * running[1:]])
    for _ in range(k - 1):
        best = np.array([0, *(min(best[i] + lengths[j - 1] * (running[j] - running[i]) for i in range(j)) for j in range(1, len(lengths) + 1))])
    found = np.array(length_buckets.best_boundaries(lengths, counts, k))
    assert len(found) <= k and (found[np.searchsorted(found, lengths)] * counts).sum() == best[-1]


def test_padded_batches(spark):
    rows = [(k, 1 + k % 7, list(range(1, 2 + k % 7))) for k in range(200)] + [(None, 2, [8, 9])] * 3
    tokens = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids array<int>")
    common.tune(spark)
    out = length_buckets.padded_batches(tokens, pad_id=0, buckets=3, budget=40).collect()
    assert sorted(str((r.doc_id, r.ids[: r.n_tokens])) for r in out) == sorted(str((i, x)) for i, _, x in rows)
    assert all(len(r.ids) == r.bucket_len and not any(r.ids[r.n_tokens :]) for r in out) and len({r.bucket_len for r in out}) == 3
    sizes = Counter((r.bucket_len, r.batch) for r in out)
    assert all(n * size <= 40 for (size, _), n in sizes.items()) and len({(r.bucket_len, r.batch, r.slot) for r in out}) == len(rows)


# --- quality rules


def test_rule_statistics(spark, data, docs):
    out = query(spark, data, "op8_quality_forest")
    for i, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = out[i]
        want = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_quality_labels(spark):
    out = entry.queries()["op8_quality_forest"](spark, "/root/testdata/sf0.01").where("not base_failed")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.95 * len(rows)


def test_quality_verdicts(spark, data, docs):
    """Each verdict from scratch: a forest over the labelled rows' ratios, each row's leaves found one by one, and every cut tried."""
    stats = {r.doc_id: r for r in quality_forest.document_statistics(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None}
    ratios = {i: quality_forest.ratios({c: np.array([r[c]]) for c in quality_forest.COUNTS})[0] for i, r in stats.items()}
    forest = quality_forest.IsolationForest(np.array([ratios[i] for i in sorted(label)]))

    def anomaly(row):
        total = 0.0
        for feature, cut, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            total += path[at]
        return 2 ** (-total / len(forest.trees) / forest.norm)

    score = {i: anomaly(row) for i, row in ratios.items()}
    failed = {i: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words for i, r in stats.items()}
    seen = sorted({score[i] for i in label if not failed[i]})
    cuts = [(a + b) / 2 for a, b in zip(seen, seen[1:])] + seen[-1:]
    loss = [sum((label[i] <= 0 and score[i] <= c) + 5 * (label[i] > 0 and score[i] > c) for i in label if not failed[i]) for c in cuts]
    best = max(c for c, n in zip(cuts, loss) if n == min(loss))
    out = query(spark, data, "op8_quality_forest")
    for i in stats:
        assert out[i].anomaly == pytest.approx(score[i], abs=1e-12)
        assert out[i].kept == (not failed[i] and (score[i] <= best or abs(score[i] - best) < 1e-12))


def test_path_lengths():
    """Each row's leaf found by walking a tree's arrays, against all rows at once."""
    rng = np.random.default_rng(4)
    rows = rng.random((300, 6))
    forest = quality_forest.IsolationForest(rows, trees=20, subsample=32)
    for row, score in zip(rows[:40], forest.score(rows)):
        total = 0.0
        for feature, cut, left, right, path in forest.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] if row[feature[at]] <= cut[at] else right[at]
            total += path[at]
        assert score == pytest.approx(2 ** (-total / 20 / quality_forest._average_path(32)))


def test_samples_are_bounded(spark):
    """One id in most rows, and one row repeated, don't pass the bound of a sample."""
    same = spark.range(20_000).select(F.lit(7).alias("doc_id"), "id").union(spark.range(20_000).select(F.lit(7), F.lit(1)))
    assert common.hash_fraction(same, 1000, 40_000).count() < 700
    assert common.hash_fraction(spark.range(4_000_000), 8, 4_000_000).count() < 30
    assert spark.range(1_000_000).where(F.xxhash64("id") <= F.lit(common.hash_limit(1, 10**15))).count() == 0
    assert common.hash_limit(0, 5) == -(1 << 63) and common.hash_limit(5, 5) == common.hash_limit(9, 5) == (1 << 63) - 1


def test_a_repeated_row_is_learned_from_once(spark):
    """However often a row comes, the tables are those of its coming once."""
    rows = [(i, f"der hund {i} ist da", "de") for i in range(20)] + [(i, f"le chien {i} est là", "fr") for i in range(20, 40)]
    schema = "doc_id long, text string, lang string"
    once = language_mixture.fit(spark.createDataFrame(rows, schema))
    many = language_mixture.fit(spark.createDataFrame(rows + rows[1:2] * 500, schema))
    assert once.langs == many.langs and all(np.array_equal(a, b) for a, b in zip(once.__dict__.values(), many.__dict__.values()) if isinstance(a, np.ndarray) and a.ndim > 1)


def test_forest_isolates_outliers():
    rows = np.vstack([np.zeros((500, 6)), np.full((5, 6), 2.0)])
    score = quality_forest.IsolationForest(rows).score(rows)
    assert score[-5:].min() > score[:500].max()


def test_all_labelled_rows_are_learned_from(spark):
    """More rows than the trees take otherwise: each in one tree, and the cut is the best of all, tried one by one."""
    common.tune(spark)
    counts = {c: (F.pmod(F.xxhash64("doc_id", F.lit(c)), F.lit(90)) + 10).alias(c) for c in quality_forest.COUNTS}
    stats = spark.range(2000).select(F.col("id").alias("doc_id")).select("doc_id", *counts.values())
    forest = quality_forest.forest_of(stats, trees=4, subsample=32)
    assert len(forest.trees) == 4 and forest.norm == quality_forest._average_path(500)
    rows = [(k % 70 / 70, k * k % 11 < 7 - k % 70 // 12) for k in range(700)]
    scores = sorted({x for x, _ in rows})
    cuts = [(a + b) / 2 for a, b in zip(scores, scores[1:])] + scores[-1:]
    loss = [sum((not good and x <= c) + 5 * (good and x > c) for x, good in rows) for c in cuts]
    found = quality_forest.calibrated(spark.createDataFrame(rows, "score double, good boolean"))
    assert found == max(c for c, n in zip(cuts, loss) if n == min(loss))
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), F.pmod("id", F.lit(2)).cast("int").alias("quality"))
    whole = quality_forest.fit(stats, labels).threshold
    usual = quality_forest.judge(stats.withColumn("good", F.pmod("doc_id", F.lit(2)) > 0), quality_forest.Judge(quality_forest.forest_of(stats), 1.0)).where("not base_failed")
    assert whole == quality_forest.calibrated(usual.select(F.col("anomaly").alias("score"), "good"))


# --- languages


def test_languages_held_out(spark):
    out = entry.queries()["op9_language_mixture"](spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)


def test_undefined_and_mixed(spark, hard):
    common.tune(spark)
    out = {r.doc_id: r for r in language_mixture.language_id(hard.where("doc_id is not null")).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (4, 5, 6, 7))
    assert not any(language_mixture.LETTER.search(x) for x in ("½", "²", "Ⅷ", "12_"))
    words = np.array([[1.0, 1e-4]] * 30 + [[1e-4, 1.0]] * 10, np.float32)
    share, chosen = language_mixture.mixtures(words, np.array([0]), np.array([40]), np.array([0.5, 0.5], np.float32))
    assert share[0, 0] == pytest.approx(0.75, abs=0.02) and chosen.all()

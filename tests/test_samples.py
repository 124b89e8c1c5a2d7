import pytest
from pyspark.sql import functions as F

from textloom.functions import numeric as N
from textloom.operators import evals, metrics, samples, shards


def test_sample_by_hand(spark):
    df = spark.createDataFrame([([1, 5, 6, 1, 7],)], "tokens array<int>")
    r = samples.samples(df, 6, 1, 0).first()
    assert (r.x, r.y, r.doc_ids, r.loss_mask) == ([1, 5, 6, 1, 7, 0], [5, 6, 1, 7, 0, 0], [0, 0, 0, 1, 1, 1], [True, True, True, True, False, False])


def test_spans_and_prefix(spark):
    df = spark.createDataFrame([([9, 1, 2, 1, 3],), ([9, 8],), ([],), (None,)], "t array<int>")
    rows = df.select(samples.spans(F.col("t"), 1).alias("s"), samples.without_prefix(F.col("t"), 1).alias("w")).collect()
    assert [tuple(x) for x in rows[0].s] == [(1, 3), (3, 5)] and rows[0].w == [1, 2, 1, 3]
    assert rows[1].s is None and rows[1].w == []
    assert rows[3].s is None


def lengths(spark, sizes):
    return spark.createDataFrame([("s", k, n) for k, n in enumerate(sizes)], "stream string, doc_id long, n long")


def test_packing_by_hand(spark):
    packed = samples.pack_next_fit(lengths(spark, [3, 4, 5, 2, 8, 1]), 8)
    totals = {r.pack: r.n for r in samples.full_packs(packed).groupBy("pack").agg(F.sum("n").alias("n")).collect()}
    assert totals == {0: 7, 1: 7, 2: 8}


def test_long_documents_are_packed_in_pieces(spark):
    packed = samples.pack_next_fit(samples.pieces(lengths(spark, [3, 17, 0, 4]), 8), 8).orderBy("doc_id", "chunk")
    assert [tuple(r)[1:] for r in packed.collect()] == [(0, 0, 3, 0, 0), (1, 0, 8, 1, 0), (1, 1, 8, 2, 0), (1, 2, 1, 3, 0), (2, 0, 0, 3, 1), (3, 0, 4, 3, 1)]


def test_packing_is_independent_of_partitions(spark):
    df = lengths(spark, [(k * 37) % 50 + 1 for k in range(300)])
    want = sorted(map(tuple, samples.pack_next_fit(df.repartition(7), 64).collect()))
    assert want == sorted(map(tuple, samples.pack_next_fit(df.coalesce(1), 64).collect()))
    assert max(p + n for _, _, n, _, p in want) <= 64


def test_shard_cut_by_hand(spark):
    rows = samples.cut_shards(lengths(spark, [3, 5, 2, 20, 1]), 8).orderBy("doc_id").collect()
    assert [(r.shard, r.place) for r in rows] == [(0, 0), (1, 0), (1, 5), (2, 0), (4, 4)]


def test_splits():
    assert shards.split_names(3, 2) == (["shard_0000.bin"], "shard_0001.bin")
    assert shards.split_names(1, 1) == ([], "shard_0000.bin")
    for bad in (0, 4):
        with pytest.raises(ValueError):
            shards.split_names(3, bad)


def test_scores_by_hand(spark):
    rows = [(0, 0, 1.0, True), (0, 0, 1.0, True), (0, 1, 1.5, True), (0, 1, 9.0, False)]
    losses = spark.createDataFrame(rows, "example_id long, candidate int, loss double, is_answer boolean")
    labels = spark.createDataFrame([(0, 0)], "example_id long, label int")
    r = evals.accuracy(evals.candidate_scores(losses), labels).first()
    assert (r.acc, r.acc_norm, r.num_total) == (0.0, 1.0, 1)
    r = evals.accuracy(evals.candidate_scores(losses.limit(0)), labels).first()
    assert (r.acc, r.num_total) == (None, 0)


def test_eval_forms(spark):
    df = spark.createDataFrame([("q", ["a", None], "1"), ("r", ["a"], None), ("s", ["a"], "")], "ctx string, endings array<string>, label string")
    assert [tuple(r) for r in evals.normalized(df, "ctx", "endings", "label").collect()] == [("q", ["a", None], 1)]
    df = spark.createDataFrame([("A \t_ b _", "x", "y", "2"), ("none", "x", "y", "1"), ("a _", "x", "y", "")], "sentence string, option1 string, option2 string, answer string")
    assert [tuple(r) for r in evals.fill_in_choices(df).collect()] == [("A", ["x b _", "y b _"], 1)]
    df = spark.createDataFrame([("q", (["u", "v"], ["A", "B"]), "B"), ("q", (["u"], ["A"]), "C"), ("q", None, "A"), ("q", (["u"], ["A"]), None)], "question string, choices struct<text: array<string>, label: array<string>>, answerKey string")
    assert [tuple(r) for r in evals.science_choices(df).collect()] == [("q", ["u", "v"], 1)]


def test_softmax_guards(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0, float("inf")],)], "z array<double>")
    p = df.select(N.softmax(F.col("z")).alias("p")).first().p
    assert abs(sum(p) - 1) < 1e-9 and p[0] == p[1] == p[3] and p[2] == max(p)


def test_sampling_from_the_largest(spark):
    import math

    z = [0.5, 2.0, -1.0, 2.0, 1.0]
    draws = [k / 200 for k in range(200)]
    df = spark.createDataFrame([(u, z) for u in draws], "u double, z array<float>")
    w = [1.0, 1.0, math.exp(-1.0)]  # of places 1, 3 and 4
    for r in df.select("u", N.sampled(F.col("z"), 3, F.col("u")).alias("t")).collect():
        goal, upto = r.u * sum(w), 0.0
        for place, x in zip((1, 3, 4), w):
            upto += x
            if upto > goal:
                break
        assert r.t == place
    empty = spark.createDataFrame([([],), (None,)], "z array<double>").select(N.sampled(F.col("z"), 3, F.lit(0.5)).alias("t"))
    assert [r.t for r in empty.collect()] == [None, None]


def test_schedules(spark):
    with pytest.raises(ValueError):
        N.learning_rate(F.lit(1), 10, 1, 1.0, 0.1, 1.0, "steps")
    with pytest.raises(ValueError):
        N.total_steps(F.lit(1), F.lit(1), F.lit(1))


def test_means(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "batch long, loss double")
    assert metrics.mean_of_first(df, 2).first().loss == 2.0
    assert metrics.mean_of_first(df.limit(0), 2).first().loss == float("inf")
    assert [tuple(r) for r in metrics.accumulated(df, 2).collect()] == [(0, 2.0)]


def test_mixture_goes_round(spark):
    docs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "source string, doc_id long")
    rows = shards.mixed(docs, spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double"), 40).orderBy("slot").collect()
    assert len(rows) == 40
    own = [r.doc_id for r in rows if r.source == "a"]
    passes = [tuple(own[k : k + 2]) for k in range(0, len(own) - 1, 2)]
    assert all(sorted(p) == [1, 2] for p in passes) and len(set(passes)) == 2  # whole passes, not all in one order
    assert [getattr(r, "pass") for r in rows if r.source == "a"] == [k // 2 for k in range(len(own))]


def test_document_ids_against_a_loop(spark):
    import random

    rng = random.Random(2)
    rows = [[rng.choice((1, 1, 5, 6, 0)) for _ in range(rng.randrange(40))] for _ in range(60)] + [[], None]
    out = spark.createDataFrame(list(enumerate(rows)), "i int, x array<int>").select("i", "x", samples.document_ids(F.col("x"), 1).alias("d")).collect()
    for r in out:
        want, n = [], -1
        for t in r.x or []:
            n += t == 1
            want.append(max(n, 0))
        assert r.d == (None if r.x is None else want)


def test_ranks_and_ties(spark):
    from textloom.operators import ranks

    rows = [("a" if k % 3 else None, k % 5, k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, x int, _row int").repartition(5)
    out = ranks.numbered(df, "g", [F.col("x")], "place").collect()
    for g in ("a", None):
        own = sorted((r.place, r.x) for r in out if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
    plan = metrics.prefix_split(df, 0.5, "x")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_missing_shards_of_a_manifest(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, shard int")
    manifest = spark.createDataFrame([(0, "val"), (1, "train")], "shard int, split string")
    assert sorted(r.doc_id for r in shards.of_training(rows, manifest).collect()) == [2, 3]


def test_samples_with_padding_among_the_tokens(spark):
    rows = [[5, 0, 6], [1, 0, 0, 1], [4, 4, 4, 4], [], [3], None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, tokens array<int>")
    for r in samples.samples(df, 4, 1, 0).collect():
        if rows[r.k] is None:
            assert (r.x, r.y, r.doc_ids, r.loss_mask) == (None,) * 4
            continue
        x = rows[r.k] + [0] * (4 - len(rows[r.k]))
        y = (rows[r.k][1:] + [0] * 4)[:4]
        assert (r.x, r.y) == (x, y)
        assert r.loss_mask == [a != 0 and b != 0 for a, b in zip(x, y)]
        assert r.doc_ids == [max(sum(t == 1 for t in x[: i + 1]) - 1, 0) for i in range(4)]


def test_text_samples_equal_samples_of_chunks(spark):
    from textloom.functions import text as T

    texts = ["ab.c." * 30, "\U0001f600é.x" * 5, ".", "", None, "a\0b.\0" * 9, "..." * 11]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, chunk int").coalesce(1)
    packs = df.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,8}"), F.lit(0))).alias("chunk", "text")).select("doc_id", "chunk", T.code_points(F.col("text")).alias("tokens"))
    columns = ("doc_id", "chunk", "x", "y", "doc_ids", "loss_mask")
    want = sorted(map(tuple, samples.samples(packs, 8, 46, 0).select(*columns).collect()))
    found = samples.text_samples(df, 8, 46, 0)
    assert sorted(map(tuple, found.select(*columns).collect())) == want
    short = samples.text_samples(df, 8, 46, 0, summary=True)
    assert sorted((r.doc_id, r.chunk, r.n_real, r.x_sum, r.n_loss, r.last_doc) for r in short.collect()) == [(i, c, sum(t != 0 for t in x), sum(x), sum(m), d[-1]) for i, c, x, _, d, m in want]
    assert samples.text_samples(df.limit(0), 8, 46, 0).collect() == []

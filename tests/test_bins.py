import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import bins, samples

SIZES = st.lists(st.integers(0, 25), max_size=40)


def one_by_one(sizes, limit, bin_=0, fill=0):
    out = []
    for n in sizes:
        if fill + n >= limit:
            bin_ += fill > 0
            out.append((bin_, 0))
            bin_, fill = bin_ + n // limit, n % limit
        else:
            out.append((bin_, fill))
            fill += n
    return out, bin_, fill


@settings(max_examples=300, deadline=None)
@given(SIZES, SIZES, st.integers(1, 12))
def test_maps_equal_the_loop(left, right, limit):
    maps = [bins.steps(np.array(x, np.int64), limit) for x in (left, right)]
    both = maps[0].then(maps[1], limit)
    for fill in range(limit):
        for found, sizes in ((maps[0], left), (both, left + right)):
            more, out = found.apply(np.array([fill]), limit)
            assert (int(more[0]), int(out[0])) == one_by_one(sizes, limit, 0, fill)[1:]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 25)), min_size=1, max_size=30), st.integers(1, 9), st.integers(1, 12))
def test_spans_equal_the_loop(rows, ranges, limit):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))
    cuts = [rows[k::1][: -(-len(rows) // ranges)] for k in range(0, len(rows), -(-len(rows) // ranges))]
    spans = []
    for own in cuts:
        first = [n for s, n in own if s == own[0][0]]
        last = [n for s, n in own if s == own[-1][0]]
        end = one_by_one(last, limit)[1:] if own[0][0] != own[-1][0] else None
        spans.append(bins.Span(own[0][0], bins.steps(np.array(first, np.int64), limit), own[-1][0], end))
    want, state, whole = None, None, None
    for span, own in zip(spans, cuts):
        state = span.leave(state, limit)
        whole = span if whole is None else whole.then(span, limit)
        for s, n in own:
            bin_, fill = want[1:] if want is not None and want[0] == s else (0, 0)
            want = (s, *one_by_one([n], limit, bin_, fill)[1:])
        assert state == want == whole.leave(None, limit)


@pytest.fixture()
def many(spark):
    """So many partitions, and none joined, that a stream is spread over all of them."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sizes", ["mixed", "equal", "zeros", "long"])
def test_one_stream_in_many_tasks(many, sizes):
    rng = random.Random(5)
    of = {"mixed": lambda: rng.randrange(60), "equal": lambda: 7, "zeros": lambda: rng.choice((0, 0, 0, 64)), "long": lambda: rng.choice((1, 2, 500))}[sizes]
    rows = [(k, of()) for k in range(6000)]
    shuffled = rng.sample(rows, len(rows))
    df = many.createDataFrame([("s", k, n) for k, n in shuffled], "stream string, doc_id long, n long").repartition(5)
    cut = samples.cut_shards(df, 100)
    got = {r.doc_id: (r.shard, r.place) for r in cut.collect()}
    want = one_by_one([n for _, n in rows], 100)[0]
    assert [got[k] for k in range(len(rows))] == want
    per_task = cut.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= len(rows) / 8
    if sizes != "long":
        packed = samples.pack_next_fit(df, 64)
        got = {r.doc_id: (r.pack, r.place) for r in packed.collect()}
        assert [got[k] for k in range(len(rows))] == one_by_one([n for _, n in rows], 65)[0]


def test_streams_ties_and_nulls(many):
    rng = random.Random(6)
    rows = [(rng.choice(("a", "b", "c", None)), rng.choice((k, k // 3, None)), rng.randrange(40)) for k in range(900)]
    df = many.createDataFrame(rows, "stream string, doc_id long, n long").coalesce(1)
    got = sorted(map(tuple, samples.cut_shards(df, 50).collect()), key=str)
    want = []
    for s in ("a", "b", "c", None):
        own = sorted(((i, n) for x, i, n in rows if x == s), key=lambda r: (r[0] is not None, r[0] or 0))
        want += [(s, i, n, *place) for (i, n), place in zip(own, one_by_one([n for _, n in own], 50)[0])]
    assert got == sorted(want, key=str)
    assert samples.cut_shards(df.limit(0), 50).collect() == []


def test_sizes_are_checked(spark):
    df = spark.createDataFrame([("s", 1, 9)], "stream string, doc_id long, n long")
    with pytest.raises(Exception, match="sizes must be"):
        samples.pack_next_fit(df, 8).collect()

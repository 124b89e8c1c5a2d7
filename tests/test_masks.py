"""Block masks against the matrix of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import masks, ranks


def by_pairs(lengths, block):
    """Kinds of all blocks from every single pair."""
    doc = [k for k, n in enumerate(lengths) for _ in range(n or 0)]
    out = {}
    for b in range(-(-len(doc) // block)):
        queries, kinds, pairs = range(b * block, min(len(doc), (b + 1) * block)), [], 0
        for k in range(-(-len(doc) // block)):
            seen = [q >= key and doc[q] == doc[key] for q in queries for key in range(k * block, min(len(doc), (k + 1) * block))]
            kinds.append("full" if all(seen) and k != b else "partial" if any(seen) else "empty")
            pairs += sum(seen)
        out[b] = kinds, pairs
    return out


@pytest.mark.parametrize("block", [2, 5, 16])
def test_blocks_against_pairs(spark, block):
    rng = random.Random(block)
    lengths = {s: [rng.choice([0, 1, 2, 3, 7, 20, 45, None]) for _ in range(rng.randrange(1, 9))] for s in range(12)}
    lengths[None] = [9, 30]
    rows = [(s, k, n, "x") for s, own in lengths.items() for k, n in enumerate(own)]
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "seq long, turn long, n int, _start string").repartition(4)
    got = {}
    for r in masks.block_masks(docs, block, "seq", [F.col("turn")]).collect():
        assert r.first_block <= r.first_full <= r.q_block
        got[r.seq, r.q_block] = r
    want = {(s, b): v for s, own in lengths.items() for b, v in by_pairs(own, block).items()}
    assert set(got) == set(want)
    for (s, b), (kinds, pairs) in want.items():
        r = got[s, b]
        ranges = ["empty"] * r.first_block + ["partial"] * (r.first_full - r.first_block) + ["full"] * (b - r.first_full) + ["partial"]
        assert ranges + ["empty"] * (len(kinds) - b - 1) == kinds and r.n_pairs == pairs


def test_edges(spark):
    nothing = spark.createDataFrame([], "seq long, turn long, n long")
    assert masks.block_masks(nothing, 4, "seq", [F.col("turn")]).count() == 0
    # one document of a million positions: rows grow with blocks, not with pairs
    long = spark.createDataFrame([(1, 0, 1_000_000)], "seq long, turn long, n long")
    out = masks.block_masks(long, 1000, "seq", [F.col("turn")]).agg(F.count(F.lit(1)), F.sum("n_pairs"), F.max("first_full")).first()
    assert tuple(out) == (1000, 1_000_000 * 1_000_001 // 2, 0)
    with pytest.raises(ValueError):
        masks.block_masks(long, 1, "seq", [F.col("turn")])


def test_sums_over_ranges(spark):
    """One group in many ranges, with ties and nulls."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [("r" if k % 9 else None, k, None if k % 7 == 0 else k % 5) for k in range(1500)]
        df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "run string, step long, n int").repartition(6)
        placed = ranks.ranged(df, "run", [F.col("step")])
        assert placed.where("_group = 'r'").select("_part").distinct().count() > 4
        sums, want = {}, []
        for run, step, n in rows:
            want.append((run, step, n, sums.get(run, 0)))
            sums[run] = sums.get(run, 0) + (n or 0)
        assert sorted(map(tuple, ranks.with_sum(df, "run", [F.col("step")], "n", "before").collect()), key=lambda r: r[1]) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)

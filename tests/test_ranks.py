"""Places and scans of one group that is spread over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import metrics, ranks


@pytest.fixture()
def many(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_one_run_in_many_ranges(many):
    rng = random.Random(3)
    rows = [("r" if k % 9 else None, k, None if rng.random() < 0.1 else 1000 - k / 10 + rng.random() * 40, k // 3 * 2) for k in range(2000)]
    df = many.createDataFrame(rng.sample(rows, len(rows)), "run string, step long, v_loss double, seconds long").repartition(6)
    best = {}
    want = []
    for run, step, loss, _ in rows:
        if loss is not None:
            want.append((run, step, loss, min(loss, best.get(run, loss)), loss < best.get(run, float("inf"))))
            best[run] = min(loss, best.get(run, loss))
    found = metrics.running_best(df)
    got = sorted((tuple(r) for r in found.select("run", "step", "v_loss", "best_val_loss", "is_best").collect()), key=lambda r: r[1])
    assert got == want
    last, want = {}, {}
    for run, step, _, seconds in rows:
        if run in last and seconds > last[run][1]:
            want[step] = (step - last[run][0]) * 10 / (seconds - last[run][1])
        last[run] = (step, seconds)
    found = metrics.throughput(df, 10)
    assert {r.step: r.tok_s for r in found.collect() if r.tok_s is not None} == want
    # ranges, not runs, are what a task holds, and nothing leaves the JVM
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
    sizes = ranks.ranged(df, "run", [F.col("step")]).groupBy("_part").count().collect()
    assert max(r["count"] for r in sizes) <= len(rows) / 6


def test_scans_of_nothing_and_of_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 5, 7), (1, 2, 1.0, 6, 7)], "run int, step int, v_loss double, seconds long, _part int")
    assert [(r.step, r.best_val_loss, r._part) for r in metrics.running_best(df).orderBy("step").collect()] == [(1, 2.0, 7), (2, 1.0, 7)]
    assert metrics.running_best(df.limit(0)).collect() == [] and metrics.throughput(df.limit(0), 1).collect() == []

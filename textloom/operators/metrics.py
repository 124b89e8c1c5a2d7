"""Run metrics: best losses, throughput, accumulation, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import ranks


def running_best(metrics: DataFrame, loss: str = "v_loss", run: str = "run") -> DataFrame:
    """Validation rows with the least loss so far in their run and whether they set it. A run is scanned by ranges."""
    rows = ranks.with_before(metrics.where(F.col(loss).isNotNull()), run, [F.col("step")], loss, "_before")
    return rows.withColumn("best_val_loss", F.least(loss, "_before")).withColumn("is_best", F.col(loss) < F.coalesce("_before", F.lit(float("inf")))).drop("_before")


def throughput(metrics: DataFrame, tokens_per_step: int, run: str = "run", ts: str = "seconds") -> DataFrame:
    """Tokens a second since the row before; null for the first of a run and where no time passed. A run is scanned by ranges."""
    rows = ranks.with_last(metrics, run, [F.col("step")], ["step", ts], "_last")
    steps, seconds = F.col("step") - F.col("_last.step"), F.col(ts) - F.col(f"_last.{ts}")
    return rows.withColumn("tok_s", F.when(seconds > 0, steps * F.lit(tokens_per_step) / seconds)).drop("_last")


def accumulated(batches: DataFrame, group: int, loss: str = "loss") -> DataFrame:
    """(optimizer_step, loss): means of `group` batches each; what doesn't fill a group is left out."""
    steps = batches.groupBy(F.floor(F.col("batch") / F.lit(group)).cast("long").alias("optimizer_step")).agg(F.sum(F.col(loss) / F.lit(float(group))).alias("loss"), F.count(F.lit(1)).alias("_n"))
    return steps.where(F.col("_n") == group).drop("_n")


def mean_of_first(batches: DataFrame, n: int, loss: str = "loss") -> DataFrame:
    """(loss): the mean of the first n batches; infinity for none."""
    return batches.orderBy("batch").limit(n).agg(F.coalesce(F.avg(loss), F.lit(float("inf"))).alias("loss"))


def masked_mean(losses: DataFrame, by: str) -> DataFrame:
    """(by, loss): the sum of losses under the mask over their number, 1 at least."""
    own = F.when(F.col("mask"), F.col("loss").cast("double"))
    return losses.groupBy(by).agg((F.coalesce(F.sum(own), F.lit(0.0)) / F.greatest(F.count(own), F.lit(1))).alias("loss"))


def activation_stats(vectors: DataFrame, values: str = "embedding") -> DataFrame:
    """(place, dead_fraction, ever_active, mean_abs): for each coordinate, how often it isn't positive, whether it ever is, and its mean size."""
    rows = vectors.select(F.posexplode(values).alias("place", "a"))
    a = F.col("a").cast("double")
    return rows.groupBy("place").agg(F.avg((a <= 0).cast("double")).alias("dead_fraction"), F.max(a > 0).alias("ever_active"), F.avg(F.abs(a)).alias("mean_abs"))


def prefix_split(df: DataFrame, share: float, *order: str) -> DataFrame:
    """With `split`: train for the first part of the global order, val for the rest. Places come from sorted ranges and their offsets, never from one task."""
    placed = ranks.numbered(df, None, [F.col(c) for c in order], "_place")
    bound = int(share * placed.count())
    return placed.withColumn("split", F.when(F.col("_place") < bound, "train").otherwise("val")).drop("_place")

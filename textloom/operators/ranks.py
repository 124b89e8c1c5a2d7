"""Places and scans within groups without one task for a whole group: sorted ranges, a row for each group and range, what the ranges before hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import scratch


def _before():
    """The ranges of a group before one."""
    return Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def ranged(df: DataFrame, by: str | None, order: list[Column]) -> DataFrame:
    """(_group, _value, _part, _at): the rows, each as one value, so that their names can't clash with ours, dealt by ranges of group and order and sorted; which range each is in; and numbers that rise within a range without gaps. Ties are broken by the rows' numbers in the table."""
    keys = [F.col("_group"), *[F.col(f"_by{k}") for k in range(len(order))], F.col("_row")]
    rows = df.select((F.col(by) if by else F.lit(0)).alias("_group"), F.struct("*").alias("_value"), *[c.alias(f"_by{k}") for k, c in enumerate(order)], F.monotonically_increasing_id().alias("_row"))
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return scratch.saved(sorted_.select("_group", "_value", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")


def joined(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows with what is known of their group in their range. One row for each group and range stands on the other side, so no key is hot: a large group lies in many ranges."""
    parts = parts.withColumnsRenamed({"_group": "_own_group", "_part": "_own_part"})
    same = placed["_group"].eqNullSafe(parts["_own_group"]) & (placed["_part"] == parts["_own_part"])
    return placed.join(parts, same).drop("_own_group", "_own_part")


def numbered(df: DataFrame, by: str | None, order: list[Column], out: str) -> DataFrame:
    """The frame with each row's place, from 0, in the order within its group (or in all): its place in its range, and how many rows of the group the ranges before hold."""
    placed = ranged(df, by, order)
    parts = placed.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = parts.select("_group", "_part", (F.coalesce(F.sum("_n").over(_before()), F.lit(0)) - F.col("_first")).alias("_start"))
    return joined(placed, starts).select("_value.*", (F.col("_start") + F.col("_at")).alias(out))


def with_before(df: DataFrame, by: str, order: list[Column], least: str, out: str) -> DataFrame:
    """The frame with the least value of a column among the rows before, in the order within the group; null for the first."""
    placed = ranged(df, by, order)
    value = F.col(f"_value.{least}")
    parts = placed.groupBy("_group", "_part").agg(F.min(value).alias("_low"))
    parts = parts.select("_group", "_part", F.min("_low").over(_before()).alias("_low"))
    within = Window.partitionBy("_group", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return joined(placed, parts).select("_value.*", F.least(F.col("_low"), F.min(value).over(within)).alias(out))


def with_last(df: DataFrame, by: str, order: list[Column], columns: list[str], out: str) -> DataFrame:
    """The frame with some columns of the row before, in the order within the group, as a struct; null for the first."""
    placed = ranged(df, by, order)
    own = F.struct(*[F.col(f"_value.{c}").alias(c) for c in columns])
    parts = placed.groupBy("_group", "_part").agg(F.max_by(own, "_at").alias("_last"))
    parts = parts.select("_group", "_part", F.lag("_last").over(Window.partitionBy("_group").orderBy("_part")).alias("_last"))
    within = Window.partitionBy("_group", "_part").orderBy("_at")
    return joined(placed, parts).select("_value.*", F.coalesce(F.lag(own).over(within), F.col("_last")).alias(out))


def with_sum(df: DataFrame, by: str, order: list[Column], column: str, out: str) -> DataFrame:
    """The frame with the sum of a whole-number column over the rows before, in the order within the group; 0 for the first. Null counts as 0."""
    placed = ranged(df, by, order)
    value = F.coalesce(F.col(f"_value.{column}").cast("long"), F.lit(0).cast("long"))
    parts = placed.groupBy("_group", "_part").agg(F.sum(value).alias("_sum"))
    parts = parts.select("_group", "_part", F.coalesce(F.sum("_sum").over(_before()), F.lit(0)).alias("_sum"))
    within = Window.partitionBy("_group", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return joined(placed, parts).select("_value.*", (F.col("_sum") + F.coalesce(F.sum(value).over(within), F.lit(0))).alias(out))

"""Shards of tokens: scatter, counts, splits, orders, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import ranks


def scattered(docs: DataFrame, shards: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """With `shard`: a seeded hash of the document's key, the same on any cluster."""
    return docs.withColumn("shard", F.pmod(T.md5_number(F.lit(seed), F.col(key)), F.lit(shards)).cast("int"))


def shard_counts(docs: DataFrame, tokens: Column) -> DataFrame:
    """(shard, n_docs, n_tokens)."""
    return docs.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def delimiter_count(tokens: Column, bos: int) -> Column:
    """How many documents a run of tokens begins."""
    return F.size(F.filter(tokens, lambda t: t == bos))


def split_names(shards: int, val_shards: int = 1) -> tuple[list[str], str]:
    """Names of the training shards and of the first held-out one, which is the one recorded; at least one must be held out."""
    if not 0 < val_shards <= shards:
        raise ValueError("hold out at least one shard and no more than there are")
    names = [f"shard_{i:04d}.bin" for i in range(shards)]
    return names[: shards - val_shards], names[shards - val_shards]


def with_split(counts: DataFrame, shards: int, val_shards: int = 1) -> DataFrame:
    """The counts with name, split (train or val) and whether the shard is the recorded held-out one."""
    split_names(shards, val_shards)
    first = shards - val_shards
    return counts.select(T.shard_name(F.col("shard")).alias("name"), "shard", "n_docs", "n_tokens", F.when(F.col("shard") < first, "train").otherwise("val").alias("split"), (F.col("shard") == first).alias("recorded"))


def epoch_order(shards: DataFrame, epochs: int, seed: int = 42, skip: int = 0, key: str = "name") -> DataFrame:
    """(epoch, place, key): each epoch's own seeded order of the shards; the first `skip` of epoch 0 are left out. For manifests, which hold a row for each shard."""
    rows = shards.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    order = Window.partitionBy("epoch").orderBy(T.md5_number(F.lit(seed) + F.col("epoch"), F.col(key)), key)
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    return rows.where((F.col("epoch") > 0) | (F.col("place") >= skip)).select("epoch", "place", key)


def shuffled_documents(docs: DataFrame, seed: int = 42, shard: str = "shard", key: str = "doc_id") -> DataFrame:
    """Documents with their place, from 0, in their shard's own seeded order."""
    return ranks.numbered(docs, shard, [T.md5_number(F.lit(seed) + F.col(shard), F.col(key)), F.col(key)], "place")


def of_training(rows: DataFrame, manifest: DataFrame, key: str = "shard") -> DataFrame:
    """Rows whose shard is among the manifest's (shard, split) training ones."""
    return rows.join(manifest.where(F.col("split") == "train").select(key), key, "left_semi")


def shard_counters(taken: DataFrame, per_shard: int) -> DataFrame:
    """(source, shards_consumed, within): for documents (source, turn) that a reader took, how many whole shards of each source it is through, and how far it is in the next."""
    rows = taken.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    return rows.select("source", F.floor(F.col("_n") / F.lit(per_shard)).cast("long").alias("shards_consumed"), F.pmod("_n", F.lit(per_shard)).cast("long").alias("within"))


def normalized_weights(mixture: DataFrame) -> DataFrame:
    """(source, weight, low, high): weights that sum to 1, and each source's share of [0, 1) in the order of names. For mixtures, which hold a row for each source."""
    every, before = Window.partitionBy(), Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    rows = mixture.withColumn("weight", F.col("weight") / F.sum("weight").over(every))
    low = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return rows.select("source", "weight", low.alias("low"), (low + F.col("weight")).alias("high"))


def draws(mixture: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(slot, source, turn): which source each of n slots takes a document from, and how many it took before. The few sources go to the slots as a broadcast range lookup."""
    slots = mixture.sparkSession.range(n).select(F.col("id").alias("slot"), T.unit_hash(F.lit(seed), F.col("id")).alias("u"))
    top = F.max("high").over(Window.partitionBy())
    shares = F.broadcast(normalized_weights(mixture).withColumn("high", F.when(F.col("high") == top, F.lit(1.0)).otherwise(F.col("high"))))
    drawn = slots.join(shares, (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return ranks.numbered(drawn.select("slot", "source"), "source", [F.col("slot")], "turn")


def mixed(docs: DataFrame, mixture: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """n documents in the order of their slots' draws, with the pass over their source: each source is gone through again and again, every time in a seeded order of its own."""
    turns = draws(mixture, n, seed)
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_size"))
    taken = turns.groupBy("source").agg(F.count(F.lit(1)).alias("_taken")).join(sizes, "source")
    passes = taken.select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_taken") - 1) / F.col("_size")))).alias("pass"))
    # as many rows as slots, and at most one more pass over each source
    again = docs.join(passes, "source").withColumn("_key", F.struct("source", "pass"))
    placed = ranks.numbered(again, "_key", [T.md5_number(F.lit(seed) + F.col("pass"), F.col(key)), F.col(key)], "_place").drop("_key")
    turns = turns.join(F.broadcast(sizes), "source").select("slot", "source", "turn", F.floor(F.col("turn") / F.col("_size")).alias("pass"), F.pmod("turn", "_size").alias("_place"))
    return turns.join(placed, ["source", "pass", "_place"]).drop("_place")


def resumed(manifest: DataFrame, consumed: DataFrame) -> DataFrame:
    """Each source with the shards it has consumed, 0 if it isn't known."""
    return manifest.join(consumed, "source", "left").withColumn("consumed", F.coalesce("consumed", F.lit(0)))

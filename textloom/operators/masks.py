"""Attention masks by blocks: which blocks of keys a block of queries sees whole, in part or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import ranks


def block_masks(docs: DataFrame, block: int, by: str, order: list[Column], n: str = "n") -> DataFrame:
    """(by, q_block, first_block, first_full, n_pairs) of sequences of documents, of which `n` has the lengths.

    A position attends to itself and to what comes before it in its document. Of the blocks of keys, those
    before first_block are empty, those up to first_full partial, those from there up to q_block full, q_block
    itself partial, and later ones empty; n_pairs is how many pairs are allowed. Positions and pairs are never
    written out: a document gives a row for each block it touches, and a block's first and last documents decide.
    Documents without a length or of length 0 take no place; ties in the order are broken by the rows' places.
    """
    if block < 2:
        raise ValueError("a block has two positions at least")
    rows = docs.where(F.col(n) > 0).select(F.col(by).alias("_by"), F.col(n).cast("long").alias("_n"), F.struct(*order).alias("_order"))
    rows = ranks.with_sum(rows, "_by", [F.col("_order")], "_n", "_start")
    size, b, start = F.lit(block), F.col("q_block"), F.col("_start")
    touched = rows.select("_by", "_start", "_n", F.explode(F.sequence(F.floor(start / size), F.floor((start + F.col("_n") - 1) / size))).alias("q_block"))
    low = F.greatest(start, b * size) - start + 1  # keys of the first and of the last query in the block
    high = F.least(start + F.col("_n"), (b + 1) * size) - start
    found = touched.groupBy("_by", "q_block").agg(F.min("_start").alias("_first"), F.max("_start").alias("_last"), F.sum((high - low + 1) * (low + high)).alias("_twice"))
    whole = F.least(F.ceil(F.col("_first") / size), b)
    return found.select(
        F.col("_by").alias(by), "q_block", F.floor(F.col("_first") / size).alias("first_block"),
        F.when(F.col("_first") == F.col("_last"), whole).otherwise(b).alias("first_full"), F.shiftright("_twice", 1).alias("n_pairs"),
    )

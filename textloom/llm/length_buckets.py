"""Packing into optimal length buckets.

Lengths are token counts of the tokenizers library, the end token included. Their global histogram,
with every length that occurs, goes through a dynamic program that chooses the bucket lengths with the
least padding. Within a bucket every document is padded to the bucket's length, and documents in order
of their ids fill batches of a token budget.

Nulls, ties and repeats: a null or empty text is the end token alone; rows with a null id come
first in their bucket; rows that share an id and a length come in the order of the table; repeated
rows each get a slot of their own; a document longer than the budget is a batch of its own, never
cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_orc

#: Buckets at most, and tokens of a batch, padding included.
BUCKETS, BUDGET = 16, 65_536
#: Pieces of a generation that a worker remembers: twice as many as where ids are written, since nothing else is held.
MEMO = 700_000


def _lengths(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = token_orc.encoder(tokenizer, MEMO)
        for batch in common.grouped(batches, token_orc.GROUP):
            with common.uncollected():
                sizes = own.sizes(batch.column(1)) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens: the ids of the whole text and an end token."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths(tokenizer), "doc_id long, n_tokens long")


def best_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths, ascending, that make the padded total least; at most `buckets` of them, as few as reach it.

    lengths: ascending and distinct. With C the running count, a bucket that ends at length j and
    begins after i costs lengths[j] * (C[j] - C[i]): for each i a line in lengths[j], so the least of
    them is on a hull, along which the lengths move. Each round allows one bucket more and takes time
    in proportion to the number of lengths. Whole numbers throughout.
    """
    d = len(lengths)
    if not d:
        return []
    ends, running = [int(x) for x in lengths], [0]
    for n in counts:
        running.append(running[-1] + int(n))
    best = [0, *[e * c for e, c in zip(ends, running[1:])]]
    history: list[list[int]] = []
    for _ in range(min(buckets, d) - 1):
        after, origin, hull = [0], [0], deque()
        for j in range(1, d + 1):
            i = j - 1  # a bucket may begin after it from here on
            while len(hull) > 1:
                a, b = hull[-2], hull[-1]
                if (best[i] - best[a]) * (running[b] - running[a]) > (best[b] - best[a]) * (running[i] - running[a]):
                    break
                hull.pop()
            hull.append(i)
            x = ends[i]
            while len(hull) > 1 and best[hull[1]] - x * running[hull[1]] <= best[hull[0]] - x * running[hull[0]]:
                hull.popleft()
            origin.append(hull[0])
            after.append(best[hull[0]] + x * (running[j] - running[hull[0]]))
        if after[d] >= best[d]:
            break
        history.append(origin)
        best = after
    found, at = [], d
    for origin in reversed(history):
        found.append(ends[at - 1])
        at = origin[at]
        if not at:
            break
    if at:
        found.append(ends[at - 1])
    return sorted(found)


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each bucket within the task; rows come sorted by bucket."""
    last, seen = None, 0
    for batch in batches:
        bucket = batch.column("bucket_len").to_numpy()
        ranks = np.empty(len(bucket), np.int64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
        for a, b in zip(starts, starts[1:]):
            seen = seen if bucket[a] == last else 0
            last = bucket[a]
            ranks[a:b] = np.arange(seen, seen + b - a)
            seen += b - a
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks)], [*batch.schema.names, "local"])


def packed(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch (numbered within the bucket, from 0) and slot (within the batch, from 0) of rows with doc_id and n_tokens, and ids if they have any."""
    ids = [c for c in lengths.columns if c == "ids"]
    lengths = common.saved(lengths.select("doc_id", "n_tokens", *ids), "lengths")
    # a row for each length that occurs: with T tokens in all, there are fewer than the root of 2 T
    histogram = lengths.groupBy(F.col("n_tokens").alias("n")).count().orderBy("n").collect()
    ends = best_boundaries([r["n"] for r in histogram], [r["count"] for r in histogram], buckets)
    bucket = F.expr(f"filter(array({', '.join(f'{x}L' for x in ends)}), x -> x >= n_tokens)[0]") if ends else F.lit(0).cast("long")
    order = ["bucket_len", "doc_id", "n_tokens", "_row"]  # numbered rows, so that one id's can be dealt to several tasks
    ordered = lengths.withColumn("bucket_len", bucket).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "doc_id long, n_tokens long, " + "ids array<int>, " * len(ids) + "bucket_len long, part int, local long"
    ranked = common.saved(ordered.drop("_row").withColumn("part", F.spark_partition_id()).mapInArrow(_ranks, schema), "ranked")
    common.drop(lengths)
    first: dict[int, int] = {}
    offsets = []
    for bucket_len, part, n in ranked.groupBy("bucket_len", "part").count().orderBy("bucket_len", "part").toLocalIterator():  # one row for each task and bucket border
        offsets.append((bucket_len, part, first.get(bucket_len, 0)))
        first[bucket_len] = offsets[-1][2] + n
    starts = ranked.sparkSession.createDataFrame(offsets, "bucket_len long, part int, start long")
    rank = F.col("start") + F.col("local")
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len"))).cast("long")
    out = ranked.join(F.broadcast(starts), ["bucket_len", "part"])
    return out.select("doc_id", "n_tokens", *ids, "bucket_len", F.floor(rank / fits).cast("long").alias("batch"), F.pmod(rank, fits).cast("int").alias("slot"))


def length_buckets(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Pack every document of a table."""
    return packed(token_counts(docs, tokenizer, id_col, text_col), buckets, budget)


def padded_batches(tokens: DataFrame, pad_id: int = 0, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """packed() of rows of token ids (doc_id, n_tokens, ids), as token_orc.read_tokens() gives them, with each row's ids padded to its bucket's length: the rows of a batch are a matrix, and the first n_tokens of each are real."""
    rows = packed(tokens.select("doc_id", "n_tokens", "ids"), buckets, budget)
    return rows.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), (F.col("bucket_len") - F.col("n_tokens")).cast("int"))))

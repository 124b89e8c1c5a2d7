"""Exact dedup by sorting content.

Texts are normalised by deleting white space. Sampled splitters deal the rows out by ranges of their
normalised bytes, each range is sorted outside of memory, and so equal texts lie next to each other:
neighbours are compared in full. What splits and sorts is the beginning of the normalised bytes and
their digest, then the length and the id, so that splitters stay small however long texts are, texts
that share a beginning are told apart, and a group of copies that fills several ranges is split. A group may go on
in the next ranges: the texts at the borders are compared in full as well, by a join, and one small
row for each range tells the driver how groups continue.

Nulls, ties and repeats: a null text is empty, and empty texts and those of white space alone are one group; rows
that share an id are rows of their own, of which at most one stays, the first in the table; a row with a null id stays
only if no other text of its group is as long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: the characters that normalising deletes.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Characters of the beginning that splits and sorts.
HEAD = 32
#: Where a row's group lies in its range: inside, or at the range's first or last row, where it may go on beyond.
INNER, FIRST, LAST = 0, 1, 2
RUNS = "doc_id long, text_sha256 string, keep_id long, n long, leads boolean, part int, edge int, border binary"


def normalised(text: Column) -> Column:
    """The text without white space."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


class _Run:
    """Equal texts of a range, as far as they have been read: ids and digest, no texts but the border's."""

    def __init__(self, digest: str, border: bytes | None):
        self.digest, self.ids, self.border = digest, [], border

    def rows(self, part: int, edge: int, border: bytes | None) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        n = len(ids)
        borders = [None] * n
        borders[0] = self.border
        if border is not None and (n > 1 or self.border is None):
            borders[-1] = border
        leads = np.zeros(n, bool)
        leads[0] = True
        columns = [ids, pa.repeat(self.digest, n), pa.repeat(ids[0], n), pa.repeat(pa.scalar(n, pa.int64()), n), pa.array(leads), pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(edge, pa.int32()), n), pa.array(borders, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RUNS.split(", ")])


def _inner(batch: pa.RecordBatch, begins: np.ndarray, part: int) -> pa.RecordBatch:
    """Whole runs that lie within one batch, many at once."""
    n = np.diff(begins)
    low, high = int(begins[0]), int(begins[-1])
    which = np.repeat(np.arange(len(n)), n)
    own = batch.slice(low, high - low)
    leads = np.zeros(high - low, bool)
    leads[begins[:-1] - low] = True
    keep = own.column(0).take(pa.array((begins[:-1] - low)[which]))
    size = high - low
    columns = [own.column(0), own.column(2), keep, pa.array(n[which].astype(np.int64)), pa.array(leads), pa.repeat(pa.scalar(part, pa.int32()), size), pa.repeat(pa.scalar(INNER, pa.int32()), size), pa.nulls(size, pa.binary())]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if k == 1 else c for k, c in enumerate(columns)], [x.split()[0] for x in RUNS.split(", ")])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text of a sorted range with the one before, in full; a row for each text with what its run holds."""
    open_run, last, part, edge = None, None, 0, FIRST
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).cast(pa.large_binary())
        part = batch.column(3)[0].as_py()
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            new[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        if last is not None:
            new[0] = texts[0].as_py() != last
        begins = np.flatnonzero(new)
        end = int(begins[0]) if len(begins) else batch.num_rows
        if end and open_run is not None:
            open_run.ids.append(batch.column(0).slice(0, end))
        if len(begins):
            if open_run is not None:
                yield open_run.rows(part, edge, None)
                edge = INNER
            if len(begins) > 1:
                done = begins
                if open_run is None:  # the range's first run
                    first = _Run(batch.column(2)[0].as_py(), texts[0].as_py())
                    first.ids.append(batch.column(0).slice(0, int(begins[1])))
                    yield first.rows(part, FIRST, None)
                    done, edge = begins[1:], INNER
                if len(done) > 1:
                    yield _inner(batch, done, part)
            low = int(begins[-1])
            open_run = _Run(batch.column(2)[low].as_py(), texts[low].as_py() if edge == FIRST else None)
            open_run.ids.append(batch.column(0).slice(low))
        last = texts[-1].as_py()
    if open_run is not None:  # a range of one run is its first and its last
        yield open_run.rows(part, edge or LAST, last)


def _continued(runs: DataFrame) -> DataFrame:
    """(part, edge, keep_id, n, leads): of the runs at the ranges' borders that belong to a larger group, what the whole group has. One row for each range goes to the driver, and no text."""
    spark = runs.sparkSession
    edges = runs.where(f"edge <> {INNER}")
    found = edges.where("leads").select("part", "edge", "keep_id", "n").orderBy("part", "edge").collect()
    parts = sorted({r["part"] for r in found})
    after = spark.createDataFrame(list(zip(parts, parts[1:])), "part int, next int")
    texts = edges.where("border is not null").select("part", "edge", "leads", "border")
    # the last row's text, of the last run or, in a range of one run, of the first; a run of one row has but one
    lasts = texts.groupBy("part").agg(F.max_by("border", F.struct("edge", ~F.col("leads"))).alias("ends"))
    firsts = texts.where(f"edge = {FIRST} and leads").select(F.col("part").alias("next"), F.col("border").alias("begins"))
    same = {r["next"] for r in lasts.join(after, "part").join(firsts, "next").where("ends = begins").select("next").collect()}
    groups: list[list] = []
    for r in found:
        if r["edge"] == FIRST and r["part"] in same:
            groups[-1].append(r)
        else:
            groups.append([r])
    rows = [(r["part"], r["edge"], g[0]["keep_id"], sum(x["n"] for x in g), r is g[0]) for g in groups if len(g) > 1 for r in g]
    return spark.createDataFrame(rows, "part int, edge int, all_keep long, all_n long, all_leads boolean")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row: of rows whose texts are equal without white space, the one with the longest original text stays, then the one with the smallest id."""
    common.tune(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text).alias("bare"), F.length(text).alias("length"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "bare", F.sha2(F.col("bare").cast("binary"), 256).alias("digest"), "length", "row")
    order = [F.substring("bare", 1, HEAD), F.col("digest"), F.desc("length"), F.asc_nulls_last("doc_id"), F.col("row")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = common.saved(ranged.select("doc_id", "bare", "digest", F.spark_partition_id().alias("part")).mapInArrow(_runs, RUNS), "runs")
    joined = runs.drop("border").join(F.broadcast(_continued(runs)), ["part", "edge"], "left")
    whole = F.col("all_n").isNotNull()
    keep = F.when(whole, F.col("all_keep")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("all_n", "n").alias("group_size"), (F.col("leads") & F.coalesce("all_leads", F.lit(True))).alias("kept"), "text_sha256")

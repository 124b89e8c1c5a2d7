"""Bins of bounded size over ordered streams, filled one after the other, without one task for a stream.

A row goes into the open bin if it fits, and else opens the next one: what a row does depends on all
before it. Yet a range of rows, entered with any fill of the open bin, opens its first own bin at
one of few rows, and from there on the fill at entry plays no part. So each range publishes, for
every row that may come first, how many bins follow and how full the last is: a map from the fill at
entry to the fill at exit. Maps of neighbouring ranges are composed, first within groups of ranges, then over the
groups, which gives every range its fill at entry; then all ranges are filled side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom import scratch
from textloom.shipping import ship


@dataclass
class Steps:
    """A range's map: for each row that may open its first bin, the size of what lies before it and up to its end, the bins that follow that one, and the last one's fill; and the size of all."""

    total: int
    low: np.ndarray
    high: np.ndarray
    bins: np.ndarray
    fill: np.ndarray

    def apply(self, fill: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins opened and fill at exit, for each fill at entry."""
        first = np.searchsorted(self.high, limit - 1 - fill, "right")
        inside = first < len(self.high)
        at = first[inside]
        bins, out = np.zeros(len(fill), np.int64), fill + self.total
        bins[inside] = self.bins[at] + (fill[inside] + self.low[at] > 0)
        out[inside] = self.fill[at]
        return bins, out

    def then(self, other: Steps, limit: int) -> Steps:
        """The map of this range and the next one."""
        bins, fill = other.apply(self.fill, limit)
        late = self.total + other.low < limit
        return Steps(
            self.total + other.total,
            np.concatenate([self.low, self.total + other.low[late]]),
            np.concatenate([self.high, self.total + other.high[late]]),
            np.concatenate([self.bins + bins, other.bins[late]]),
            np.concatenate([fill, other.fill[late]]),
        )


def steps(sizes: np.ndarray, limit: int) -> Steps:
    """The map of rows of these sizes. A row of `limit` or more fills bins of its own and begins the next."""
    upto = np.cumsum(sizes)
    before = upto - sizes
    starts = np.flatnonzero((sizes > 0) & (before < limit))
    rest, whole = sizes % limit, sizes // limit
    bins, fill = whole[starts], np.zeros(len(starts), np.int64)
    live, at = np.arange(len(starts)), starts
    while len(live):  # from each start to the next row that doesn't fit
        after = np.searchsorted(upto, upto[at] - rest[at] + limit - 1, "right")
        out = after == len(sizes)
        fill[live[out]] = rest[at[out]] + upto[-1] - upto[at[out]]
        live, last, at = live[~out], at[~out], after[~out]
        bins[live] += whole[at] + (rest[last] + before[at] - upto[last] > 0)
    return Steps(int(upto[-1]) if len(upto) else 0, before[starts], upto[starts], bins, fill)


@dataclass
class Span:
    """Some neighbouring ranges: the stream they begin with, the map of its rows there, the stream they end with, and its (bins, fill) if it begins within."""

    first: str | None
    map: Steps
    last: str | None
    exit: tuple[int, int] | None

    def leave(self, state: tuple | None, limit: int) -> tuple:
        """(stream, bins, fill) at the end, from the same at the beginning."""
        if self.exit is not None:
            return (self.last, *self.exit)
        bins, fill = (state[1], state[2]) if state is not None and state[0] == self.first else (0, 0)
        more, out = self.map.apply(np.array([fill]), limit)
        return (self.last, bins + int(more[0]), int(out[0]))

    def then(self, other: Span, limit: int) -> Span:
        if self.exit is None and self.last == other.first:
            return Span(self.first, self.map.then(other.map, limit), other.last, other.exit)
        state = (self.last, *self.exit) if self.exit is not None else None
        return Span(self.first, self.map, other.last, other.leave(state, limit)[1:])


#: A span as a row; arrays of whole numbers as bytes.
SPAN = "first string, total long, low binary, high binary, bins binary, fill binary, last string, exit_bins long, exit_fill long"
_NAMES = [x.split()[0] for x in SPAN.split(", ")]


def _written(span: Span) -> list:
    m = span.map
    return [span.first, m.total, *[np.asarray(x, np.int64).tobytes() for x in (m.low, m.high, m.bins, m.fill)], span.last, *(span.exit or (None, None))]


def _read(row: dict) -> Span:
    arrays = [np.frombuffer(row[c], np.int64) for c in ("low", "high", "bins", "fill")]
    return Span(row["first"], Steps(row["total"], *arrays), row["last"], None if row["exit_bins"] is None else (row["exit_bins"], row["exit_fill"]))


class _Segment:
    """Sizes of one stream's rows within a range."""

    def __init__(self, stream: str | None):
        self.stream, self.sizes = stream, []

    def map(self, limit: int) -> Steps:
        return steps(np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64), limit)


def _borders(batch: pa.RecordBatch) -> list[tuple[str | None, int, int]]:
    """Runs of one stream in a sorted batch: the stream, and where it begins and ends."""
    coded = batch.column(0).dictionary_encode("encode")
    codes = coded.indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
    return [(coded.dictionary[int(codes[a])].as_py(), a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _publish(limit: int, most: int, schema: pa.Schema):
    """The rows of a sorted range, numbered, and a last row with the range's span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = own = None
        part, n = 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(batch.num_columns - 1)[0].as_py()
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            if sizes.min() < 0 or sizes.max() > most:
                raise ValueError(f"sizes must be from 0 to {most}")
            for stream, a, b in _borders(batch):
                if own is None or stream != own.stream:
                    own = _Segment(stream)
                    first = first or own
                own.sizes.append(sizes[a:b])
            places = pa.array(np.arange(n, n + batch.num_rows))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, places, *[pa.nulls(batch.num_rows, f.type) for f in list(schema)[batch.num_columns + 1 :]]], schema.names)
        if own is not None:
            end = None
            if own is not first:
                bins, fill = own.map(limit).apply(np.zeros(1, np.int64), limit)
                end = (int(bins[0]), int(fill[0]))
            values = _written(Span(first.stream, first.map(limit), own.stream, end))
            width = len(schema) - len(values)
            row = [None] * (width - 2) + [part, None] + values
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema.names)

    return run


def _composed(limit: int):
    """The span of each group of ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Span] = {}
        for batch in batches:
            for row in batch.to_pylist():
                span = _read(row)
                held[row["group"]] = held[row["group"]].then(span, limit) if row["group"] in held else span
        rows = [[group, *_written(span)] for group, span in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *_columns([r[1:] for r in rows])], ["group", *_NAMES])

    return run


def _columns(rows: list[list]) -> list[pa.Array]:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return [pa.array([r[k] for r in rows], kinds[x.split()[1]]) for k, x in enumerate(SPAN.split(", "))]


def _entries(limit: int, states: dict[int, tuple | None]):
    """What each range of a group is entered with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    group, state = row["group"], states[row["group"]]
                out.append((row["part"], *(state or (None, None, None))))
                state = _read(row).leave(state, limit)
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "stream", "bins", "fill"])

    return run


def _fill(limit: int, entered: dict[int, tuple | None], names: list[str]):
    """Bins and places of the rows, range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = stream = None
        bins = fill = 0
        for batch in batches:
            bin_of, places = [], []
            parts, streams, sizes = batch.column(batch.num_columns - 2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for p, s, n in zip(parts, streams, sizes):
                if p != part:
                    part = p
                    stream, bins, fill = entered[p] or (s, 0, 0)
                if s != stream:
                    stream, bins, fill = s, 0, 0
                if fill + n < limit:
                    bin_of.append(bins)
                    places.append(fill)
                    fill += n
                else:
                    bins += fill > 0
                    bin_of.append(bins)
                    places.append(0)
                    bins += n // limit
                    fill = n % limit
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(bin_of, pa.int64()), pa.array(places, pa.int64())], names)

    return run


def filled(rows: DataFrame, limit: int, order: list[str], out: str, most: int | None = None) -> DataFrame:
    """(stream, n, the columns of the order, out, place): for rows (stream, n, order), the bin of their stream they begin in, from 0, and the place there, in the order and, for equals, that of the table.

    A row that would fill the open bin to `limit` or beyond opens the next, and one of `limit` or
    more runs on into further ones; a size over `most` is an error. Two shuffles of these narrow
    rows; the driver sees a map for each group of ranges, about as many as the root of their number, and a state for each
    range. A map has an entry for each row among the first `limit` of a range, at most.
    """
    spark = rows.sparkSession
    ship(spark)
    keys = ["stream", *order, "_row"]
    given = rows.select(F.col("stream").cast("string").alias("stream"), F.col("n").cast("long").alias("n"), *order).withColumn("_row", F.monotonically_increasing_id())
    ranged = given.repartitionByRange(*keys).sortWithinPartitions(*keys).select("stream", "n", *order, F.spark_partition_id().alias("part"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    full = f"{fields}, local long, {SPAN}"
    arrow = to_arrow_schema(T._parse_datatype_string(full))
    placed = scratch.saved(ranged.mapInArrow(_publish(limit, (1 << 62) if most is None else most, arrow), full), "bins")
    spans = placed.where("total is not null")
    size = max(1, math.isqrt(spans.count()))
    grouped = spans.withColumn("group", F.floor(F.col("part") / F.lit(size)).cast("int")).select("group", "part", *_NAMES).repartitionByRange("group").sortWithinPartitions("group", "part")
    states, state = {}, None
    for row in sorted((r.asDict() for r in grouped.mapInArrow(_composed(limit), f"group int, {SPAN}").collect()), key=lambda r: r["group"]):
        states[row["group"]] = state
        state = _read(row).leave(state, limit)
    found = grouped.mapInArrow(_entries(limit, states), "part int, stream string, bins long, fill long").collect()
    entered = {p: None if bins is None else (s, bins, fill) for p, s, bins, fill in found}
    own = placed.where("total is null").select("stream", "n", *order, "part", "local").repartitionByRange("part").sortWithinPartitions("part", "local")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-2])
    return own.mapInArrow(_fill(limit, entered, [*own.columns[:-2], out, "place"]), f"{kept}, `{out}` long, place long")

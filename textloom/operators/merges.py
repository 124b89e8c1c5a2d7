"""Byte-pair merges over a table of counted chunks, many in one pass, in exactly the greedy order.

The chunks stay in a table, as runs of ids. A pass takes the most frequent pairs, applies them one
after the other to each chunk that holds them, and adds up by how much each step changes the counts of which
pairs. With these sums the driver replays the greedy choice over the few pairs that could be
chosen at all, and takes the merges as long as the choice agrees with the order in which they were
applied; the others are left for the next pass. Counts of pairs are a table as well, to which a pass adds its
changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import scratch
from textloom.shipping import ship

#: Merges that a pass tries at most, and beyond twice as many as the last one took; and the share of the highest count that the least of them has.
TRIED, MORE, SHARE = 64, 6, 0.25
#: A run of ids as bytes of 32-bit integers with its chunk's count; or a change: the step, the pair and by how much.
ROWS = "run binary, weight long, step int, pair_left int, pair_right int, n long"
BORDER = -1

Pair = tuple[int, int]


def merged(flat: np.ndarray, pair: Pair, made: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs after each other, with a border after each, once a pair is merged, leftmost first; and where the merged pairs were."""
    at = np.flatnonzero((flat[:-1] == pair[0]) & (flat[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):  # of a row of equals every other one
        begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        at = at[(np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))) % 2 == 0]
    if not len(at):
        return flat, at
    out = flat.copy()
    out[at] = made
    keep = np.ones(len(flat), bool)
    keep[at + 1] = False
    return out[keep], at


def _totals(codes: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Added weights by pair; weights are whole and added as such."""
    own, back = np.unique(codes, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, back, weights)
    left, right = np.divmod(own, n)
    return left, right, total


class _Batch:
    """Runs laid out one after the other, each followed by a border."""

    def __init__(self, runs: list[bytes], weights: np.ndarray):
        self.flat = np.frombuffer(b"".join(r + b"\xff\xff\xff\xff" for r in runs), np.int32)
        self.weights = weights

    def runs(self) -> list[bytes]:
        ends = np.flatnonzero(self.flat == BORDER)
        data = self.flat.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]

    def pairs(self, flat: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of neighbours within the runs, and their weights."""
        owner = np.cumsum(flat == BORDER) - (flat == BORDER)
        inner = (flat[:-1] != BORDER) & (flat[1:] != BORDER)
        return (flat[:-1].astype(np.int64) * n + flat[1:])[inner], weights[owner[:-1][inner]]


def _around(flat: np.ndarray, owner: np.ndarray, starts: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the pairs that start at some places, each place once."""
    starts = np.unique(starts)
    starts = starts[(starts >= 0) & (starts < len(flat) - 1)]
    starts = starts[(flat[starts] != BORDER) & (flat[starts + 1] != BORDER)]
    return flat[starts].astype(np.int64) * n + flat[starts + 1], weights[owner[starts]]


def _pass(done: list[tuple[Pair, int]], tried: list[tuple[Pair, int]], n: int):
    """Runs after the merges that are done, then what each of the tried ones would change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _Batch(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            for pair, made in done:
                own.flat = merged(own.flat, pair, made)[0]
            flat, weights = own.flat, own.weights
            owner = (np.cumsum(flat == BORDER, dtype=np.int32) - (flat == BORDER)).astype(np.int32)
            for step, (pair, made) in enumerate(tried):
                after, at = merged(flat, pair, made)
                if not len(at):
                    continue
                keep = np.ones(len(flat), bool)
                keep[at + 1] = False
                later, place = owner[keep], at - np.arange(len(at))  # each merge before has removed one place
                # only pairs that touch a merged one change
                before = _around(flat, owner, np.concatenate([at - 1, at, at + 1]), weights, n)
                new = _around(after, later, np.concatenate([place - 1, place]), weights, n)
                for a, b, total in zip(*(x.tolist() for x in _totals(np.concatenate([before[0], new[0]]), np.concatenate([-before[1], new[1]]), n))):
                    key = (step, a, b)
                    changes[key] = changes.get(key, 0) + total
                flat, owner = after, later
            runs = own.runs()
            size = len(runs)
            yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), batch.column(1), *[pa.nulls(size, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())]], _NAMES)
        rows = [(*k, v) for k, v in changes.items() if v]
        for at in range(0, len(rows), 100_000):
            columns = list(zip(*rows[at : at + 100_000]))
            size = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]], _NAMES)

    return run


_NAMES = [x.split()[0] for x in ROWS.split(", ")]


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _Batch(batch.column(0).to_pylist(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(_totals(*own.pairs(own.flat, own.weights, n), n), (pa.int32(), pa.int32(), pa.int64()))], ["pair_left", "pair_right", "n"])

    return run


def agreed(known: dict[Pair, int], tried: list[tuple[Pair, int]], changes: dict[int, list[tuple[Pair, int]]]) -> int:
    """How many of the tried merges are the greedy ones. known: the pairs that were most frequent before, all of those at least as good as the last one tried; changes: by step, of these pairs and of new ones that may become as frequent."""
    counts, last = dict(known), min((n, (-a, -b)) for (a, b), n in known.items())
    for step, (pair, _) in enumerate(tried):
        n, negative = max((n, (-a, -b)) for (a, b), n in counts.items())
        if (-negative[0], -negative[1]) != pair or (n, negative) < last:
            return step
        for p, more in changes.get(step, ()):
            counts[p] = counts.get(p, 0) + more
    return len(tried)


def learned(runs: DataFrame, base: int, most: int) -> dict[int, Pair]:
    """At most `most` merges, by the id each makes, from `base` on: the most frequent pair first, the smallest of equals. runs: (run, weight) as in ROWS, ids below `base`.

    Each pass is one narrow job over the chunks, of which nothing is collected. The driver gets the pairs tried and those that
    come up to the least of them, some hundreds at most.
    """
    spark = runs.sparkSession
    ship(spark)
    top = base + most + 1
    state = runs
    counts = scratch.saved(runs.mapInArrow(_counted(top), "pair_left int, pair_right int, n long").groupBy("pair_left", "pair_right").agg(F.sum("n").alias("n")), "pairs")
    out: dict[int, Pair] = {}
    done: list[tuple[Pair, int]] = []
    taken = 0
    while len(out) < most:
        best = counts.orderBy(F.desc("n"), "pair_left", "pair_right").limit(min(TRIED, 2 * taken + MORE)).collect()
        if not best or best[0]["n"] <= 0:
            break
        known = {(r["pair_left"], r["pair_right"]): r["n"] for r in best if r["n"] > 0 and r["n"] >= SHARE * best[0]["n"]}
        tried = [(p, base + len(out) + k) for k, p in enumerate(known)][: most - len(out)]
        table = scratch.saved(state.mapInArrow(_pass(done, tried, top), ROWS), "merges")
        changes = table.where("step is not null").groupBy("step", "pair_left", "pair_right").agg(F.sum("n").alias("n"))
        least = min(known.values())
        listed = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("r")) for a, b in known])
        gains = F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(0))).over(Window.partitionBy("pair_left", "pair_right"))
        found = changes.withColumn("gains", gains).where((F.col("gains") >= least) | F.array_contains(listed, F.struct(F.col("pair_left").alias("l"), F.col("pair_right").alias("r"))))
        by_step: dict[int, list[tuple[Pair, int]]] = {}
        for r in found.collect():
            by_step.setdefault(r["step"], []).append(((r["pair_left"], r["pair_right"]), r["n"]))
        taken = agreed(known, tried, by_step)
        done = tried[:taken]
        out.update((made, pair) for pair, made in done)
        added = changes.where(F.col("step") < taken).select("pair_left", "pair_right", "n")
        new = scratch.saved(counts.unionByName(added).groupBy("pair_left", "pair_right").agg(F.sum("n").alias("n")).where("n > 0"), "pairs")
        if hasattr(state, "_table"):
            scratch.drop(state._table)
        scratch.drop(counts)
        counts, state = new, table.where("step is null").select("run", "weight")
        state._table = table
    scratch.drop(counts)
    if hasattr(state, "_table"):
        scratch.drop(state._table)
    return out

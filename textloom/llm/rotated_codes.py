"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors go to the lists of the nearest of some centroids, are taken relative to them, rotated by
one random orthogonal matrix and reduced to the signs of their coordinates, packed into bits, with
two scalars: the length, and the inner product of the unit vector with its own code. A query is
rotated likewise and rounded to four bits a coordinate, so that popcounts of the packed code with
the four bit planes give an unbiased estimate of the inner product, with an error bound. Only
vectors whose lower bound is within the k-th smallest upper bound, and within the k-th distance
found so far, are compared in full. The codes are used at every size of table.

Every vector is indexed. A query searches the lists nearest to it; how many is calibrated on pilot
queries, which search all lists, so that 99 % of their neighbours are found. A list is cut into
blocks of rows and queries of bounded size, so no list, however many rows or queries it has, is
one task. Equal vectors are searched once, whatever their number: of each, the ids that can be
among the k nearest are kept.

Nulls, ties and repeats: rows with a null id, and vectors that are null, zero, of another length
than the most frequent one (of equally frequent ones the shortest), or that hold null or
non-finite components, take no part; ties go to the smaller id; rows that repeat both id and
vector are one candidate, a row that repeats an id with another vector is a candidate of its own,
but never for that id, and of rows that repeat a query's id the vector that sorts first asks; an
empty table, or one without queries, gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Half-width of the error bound, in standard deviations of the estimate: the share of true neighbours outside it is under 1 %.
BOUND = 2.5
#: Bits of a query's coordinates.
PLANES = 4
#: Lists at most, the sample that centroids are fitted to (rows, and bytes at most), and rounds of that fit.
LISTS, SAMPLE, SAMPLE_BYTES, ROUNDS = 4096, 65_536, 64 << 20, 6
#: Pilot queries, and the share of their neighbours that must be in the lists searched.
PILOT, SHARE = 256, 0.99
#: Rows and queries of a block at most, about; rows and queries compared at once; pairs compared in full at once.
BLOCK_ROWS, BLOCK_QUERIES, ROWS, QUERIES, PAIRS = 16_384, 4096, 2048, 512, 100_000

INDEX = "key long, ids array<long>, v array<double>, list int, code binary, length double, own double"
BLOCKS = "block long, kind int, key long, ids array<long>, v array<double>, code binary, length double, own double"
FOUND = "query long, list int, ids array<long>, score double"


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as 64-bit words."""
    found = np.packbits(bits, axis=-1)
    return np.ascontiguousarray(np.pad(found, [(0, 0)] * (found.ndim - 1) + [(0, -found.shape[-1] % 8)])).view(np.uint64)


def encode(vectors: np.ndarray, centers: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths of the vectors relative to their centres, and inner products of the unit vectors with their codes."""
    rest = (vectors - centers) @ turn.T
    length = np.sqrt((rest * rest).sum(1))
    own = np.abs(rest).sum(1) / np.maximum(length, 1e-30) / np.sqrt(vectors.shape[1])
    return packed(rest > 0), length, np.where(length > 0, own, 1.0)


class Queries:
    """Queries relative to one centre: lengths, bit planes of their rounded unit vectors, and what rounding lost."""

    def __init__(self, vectors: np.ndarray, center: np.ndarray, turn: np.ndarray):
        rest = (vectors - center) @ turn.T
        self.dim, self.length = vectors.shape[1], np.sqrt((rest * rest).sum(1))
        unit = rest / np.maximum(self.length, 1e-30)[:, None]
        self.low = unit.min(1)
        self.step = np.maximum((unit.max(1) - self.low) / (2**PLANES - 1), 1e-30)
        level = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [packed(level >> b & 1) for b in range(PLANES)]
        self.total = self.dim * self.low + self.step * level.sum(1)
        self.lost = np.sqrt(((self.low[:, None] + self.step[:, None] * level - unit) ** 2).sum(1))

    def bounds(self, codes: np.ndarray, length: np.ndarray, own: np.ndarray, part: slice, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
        """For each row and each query of a part, the least and the greatest squared distance that the estimate and its error bound allow."""
        sums = np.zeros((len(codes), len(self.length[part])), np.float32)
        for b, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                sums += np.bitwise_count(codes[:, w, None] & plane[None, part, w]) * np.float32(1 << b)
        ones = np.bitwise_count(codes).sum(1).astype(np.float32)
        low, step, total = (x[part].astype(np.float32) for x in (self.low, self.step, self.total))
        inner = 2 * (low[None] * ones[:, None] + step[None] * sums) - total[None]
        scale = (1 / own).astype(np.float32)
        cosine = inner * (scale / np.float32(np.sqrt(self.dim)))[:, None]
        spread = np.maximum(1 - own * own, 0) / (own * own) / max(self.dim - 1, 1)
        error = np.sqrt(spread.astype(np.float32)[:, None] + (scale * scale / self.dim)[:, None] * (self.lost[part].astype(np.float32) ** 2)[None])
        error *= bound
        squares = (length * length)[:, None] + (self.length[part] ** 2)[None]
        product = 2 * length[:, None] * self.length[None, part]
        return squares - product * np.minimum(cosine + error, 1), squares - product * np.maximum(cosine - error, -1)


class Nearest:
    """The k nearest rows seen so far for each of some queries; `compared` counts comparisons in full."""

    def __init__(self, vectors: np.ndarray, k: int):
        self.vectors, self.k, self.compared = vectors, k, 0
        self.limit = np.full(len(vectors), np.inf)
        self.query, self.dist, self.first, self.list = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, object)

    def add(self, queries: Queries, at: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray) -> None:
        """Compare rows of list `at` with all queries: by the codes, then in full where the bounds allow."""
        for low in range(0, len(self.vectors), QUERIES):
            part = slice(low, low + QUERIES)
            least, most = queries.bounds(codes, length, own, part)
            limit = self.limit[part] ** 2
            if len(codes) >= self.k:
                limit = np.minimum(limit, np.partition(most, self.k - 1, axis=0)[self.k - 1])
            rows, query = np.nonzero(least <= (limit * (1 + 1e-6) + 1e-9)[None])
            for some in range(0, len(rows), PAIRS):
                self.compare(at, ids, vectors, rows[some : some + PAIRS], query[some : some + PAIRS] + low)

    def compare(self, at: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> None:
        """Take in the true distances of pairs, and keep the k nearest of each query, of equals those with the smaller first id."""
        self.compared += len(rows)
        gap = vectors[rows] - self.vectors[queries]
        dist = np.sqrt((gap * gap).sum(1))
        near = dist <= self.limit[queries]
        rows, query, dist = rows[near], np.append(self.query, queries[near]), np.append(self.dist, dist[near])
        own = ids[rows]
        first = np.append(self.first, np.array([x[0] for x in own], np.int64))
        order = np.lexsort((first, dist, query))
        query = query[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        keep, last = place < self.k, place == self.k - 1
        self.limit[query[last]] = np.minimum(self.limit[query[last]], dist[order][last])
        order = order[keep]
        self.ids, self.list = np.append(self.ids, own)[order], np.append(self.list, np.full(len(own), at, np.int32))[order]
        self.query, self.dist, self.first = query[keep], dist[order], first[order]

    def batch(self, keys: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(keys[self.query], pa.int64()), pa.array(self.list, pa.int32()), pa.array(list(self.ids), pa.list_(pa.int64())), pa.array(self.dist)]
        return pa.RecordBatch.from_arrays(columns, ["query", "list", "ids", "score"])


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return (rows.where(F.size("v") == sizes["n"]), sizes["n"]) if sizes else (rows, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _objects(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """key, ids and v of each distinct vector; ids are its smallest ones, at most `most`. What a task holds of a vector is cut to those before it is shuffled."""
    once = rows.select("v", "id").distinct()
    some = once.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= most)
    every = some.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return common.saved(every.select(F.monotonically_increasing_id().alias("key"), "ids", "v"), "vectors")


def _gaps(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to the centres, less the vector's own square."""
    return (centers * centers).sum(1)[None] - 2 * (vectors @ centers.T)


def nearest_center(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([_gaps(vectors[at : at + ROWS], centers).argmin(1) for at in range(0, len(vectors), ROWS)] or [np.zeros(0, np.int64)])


def fitted_centers(sample: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows of the sample."""
    sample = sample[np.lexsort(sample.T)]
    centers = sample[np.random.default_rng(seed).choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_center(sample, centers)
        order = np.argsort(own, kind="stable")
        there, first = np.unique(own[order], return_index=True)
        centers = centers.copy()
        centers[there] = np.add.reduceat(sample[order], first, axis=0) / np.diff(np.append(first, len(own)))[:, None]
    return centers


def build_index(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """Each vector with its list, its code and two scalars, written to the shared folder."""
    dim = centers.shape[1]
    turn, shared = rotation(dim), vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(2), dim)
            own = nearest_center(found, shared.value)
            codes, length, inner = encode(found, shared.value[own], turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(length), pa.array(inner)], ["key", "ids", "v", "list", "code", "length", "own"])

    return common.saved(vectors.mapInArrow(run, INDEX), "codes")


def probes(index: DataFrame, pilot: np.ndarray, centers: np.ndarray, k: int) -> int:
    """How many lists hold SHARE of the pilot queries' neighbours, who search all lists by the codes."""
    dim, turn = centers.shape[1], rotation(centers.shape[1])
    shared = index.sparkSession.sparkContext.broadcast((pilot, centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, centers = shared.value
        found, known = Nearest(queries, k), {}
        for batch in batches:
            own, codes, vectors, ids = batch.column(3).to_numpy(), _codes(batch.column(4)), _matrix(batch.column(2), dim), _objects(batch.column(1))
            length, inner = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            for at in np.unique(own):
                rows = own == at
                if at not in known:
                    known[at] = Queries(queries, centers[at], turn)
                found.add(known[at], int(at), ids[rows], vectors[rows], codes[rows], length[rows], inner[rows])
                if len(known) > 64:
                    known.clear()
        yield found.batch(np.arange(len(queries)))

    every = index.mapInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]))
    near = every.withColumn("_n", rank).where(F.col("_n") <= k).select("query", "list").collect()  # k rows for each pilot query
    place = np.argsort(np.argsort(_gaps(pilot, centers), axis=1, kind="stable"), axis=1, kind="stable")
    ranks = np.sort([place[r["query"], r["list"]] for r in near])
    return int(ranks[min(len(ranks) - 1, int(SHARE * len(ranks)))]) + 1


def _mixed(keys: np.ndarray) -> np.ndarray:
    found = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return found >> np.uint64(32)


def _dealt(batch_keys: np.ndarray, own: np.ndarray, rows: np.ndarray, chunks: np.ndarray, copies: np.ndarray, shift: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and blocks: a row of a list goes to its chunk (by hash) of `chunks`, once for each of the `copies` of the other side."""
    chunk = (_mixed(batch_keys[rows]) % chunks[own].astype(np.uint64)).astype(np.int64)
    times = copies[own]
    other = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(rows, times), np.repeat((own.astype(np.int64) << 40) | (chunk << shift[0]), times) | (other << shift[1])


def _row_blocks(row_chunks: np.ndarray, query_chunks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3).to_numpy()
            rows, blocks = _dealt(batch.column(0).to_numpy(), own, np.arange(len(own)), row_chunks, query_chunks, (20, 0))
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.ones(len(rows), np.int32)), *(out.column(k) for k in (0, 1, 2, 4, 5, 6))], [f.split()[0] for f in BLOCKS.split(", ")])

    return run


def _probed(vectors: np.ndarray, centers: np.ndarray, most: int) -> np.ndarray:
    gaps = _gaps(vectors, centers)
    return np.argpartition(gaps, most - 1, axis=1)[:, :most] if most < len(centers) else np.repeat(np.arange(len(centers))[None], len(vectors), 0)


def _query_counts(shared, dim: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            total += np.bincount(_probed(_matrix(batch.column(1), dim), shared.value, most).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["list", "n"])

    return run


def _query_blocks(shared, dim: int, most: int, row_chunks: np.ndarray, query_chunks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _probed(_matrix(batch.column(1), dim), shared.value, most)
            rows, blocks = _dealt(batch.column(0).to_numpy(), own.ravel(), np.repeat(np.arange(len(own)), own.shape[1]), query_chunks, row_chunks, (0, 20))
            out, n = batch.take(pa.array(rows)), len(rows)
            rest = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.zeros(n, np.int32)), out.column(0), pa.nulls(n, pa.list_(pa.int64())), out.column(1), *rest], [f.split()[0] for f in BLOCKS.split(", ")])

    return run


def _search(shared, dim: int, k: int):
    """Each block's rows against its queries, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, turn = shared.value, rotation(dim)
        block, keys, vectors, queries, found = -1, [], [], None, None
        for batch in batches:
            blocks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    if found is not None:
                        yield found.batch(np.concatenate(keys))
                    block, keys, vectors, queries, found = blocks[a], [], [], None, None
                if kinds[a] == 0:
                    keys.append(part.column(2).to_numpy())
                    vectors.append(_matrix(part.column(4), dim))
                    continue
                if not keys:
                    continue
                at = int(block) >> 40
                if found is None:
                    found = Nearest(np.concatenate(vectors), k)
                    queries = Queries(found.vectors, centers[at], turn)
                found.add(queries, at, _objects(part.column(3)), _matrix(part.column(4), dim), _codes(part.column(5)), part.column(6).to_numpy(), part.column(7).to_numpy())
        if found is not None:
            yield found.batch(np.concatenate(keys))

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest rows. is_query: a condition on the column `id`."""
    spark = vectors.sparkSession
    context, schema = spark.sparkContext, "query_id long, rank int, vec_id long, score double"
    rows, dim = _valid(vectors, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], schema)
    every = distinct_vectors(rows, k + 1)
    asking = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    asked = common.saved(asking.join(every.select("key", "v"), "v").select(F.col("id").alias("query_id"), "key"), "asked")
    wanted = common.saved(every.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v"), "queries")
    size, n = every.count(), wanted.count()
    if not n:
        return spark.createDataFrame([], schema)
    most = int(min(SAMPLE, SAMPLE_BYTES // (8 * dim) + 1))
    lists = max(1, min(int(size**0.5), LISTS, most // 16))
    sample = common.hash_fraction(every.select("v"), min(most, 64 * lists), size).collect()
    centers = fitted_centers(np.array([r["v"] for r in sample]), min(lists, len(sample)))
    index = build_index(every, centers)
    pilot = np.array([r["v"] for r in common.hash_fraction(wanted.select("v"), PILOT, n).collect()]).reshape(-1, dim)
    if not len(pilot):
        pilot = np.array([r["v"] for r in wanted.orderBy("key").limit(1).collect()])
    near, shared = probes(index, pilot, centers, k + 1), context.broadcast(centers)
    row_chunks, query_chunks = np.ones(len(centers), np.int64), np.zeros(len(centers), np.int64)
    for r in index.groupBy("list").count().collect():  # a row for each list, as below
        row_chunks[r["list"]] = -(-r["count"] // BLOCK_ROWS)
    counts = wanted.mapInArrow(_query_counts(shared, dim, near), "list int, n long").groupBy("list").agg(F.sum("n").alias("n"))
    for r in counts.collect():
        query_chunks[r["list"]] = -(-r["n"] // BLOCK_QUERIES)
    blocks = index.mapInArrow(_row_blocks(row_chunks, query_chunks), BLOCKS).union(wanted.mapInArrow(_query_blocks(shared, dim, near, row_chunks, query_chunks), BLOCKS))
    found = common.saved(blocks.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_search(shared, dim, k + 1), FOUND), "found")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("ids")[0]))
    best = common.saved(found.withColumn("_n", rank).where(F.col("_n") <= k + 1).select(F.col("query").alias("key"), "ids", "score"), "nearest")
    common.drop(every, index, wanted, found)
    pairs = best.join(asked, "key").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

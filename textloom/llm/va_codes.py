"""Codes of vectors: product quantisation with whole numbers, searched through a VA-file.

A vector is cut into parts, each part has a codebook, and a part's code is its nearest entry. The
search for it is that of a VA-file: each coordinate of the codebook is cut into a few cells, and an
entry is known by the cells it lies in. For a part, a table tells for each coordinate and cell how
near and how far an entry of the cell may be; sums over the coordinates bound every entry's
distance from below and above. Only entries whose lower bound doesn't exceed the least upper bound
are compared, with distances in whole numbers. Codebooks are moved to their parts' means in rounds; tasks
send sums and counts for each entry, so what goes to the driver depends on the codebooks' size alone.

Nulls, ties and repeats: vectors null or with components null or not finite are dropped. All
vectors have the length of the kept vector that sorts first; others are dropped too. A length that isn't a multiple of the parts is
filled up with zeros. Repeated rows count each time. The first entries are those of the smallest ids, rows
of one id in the order of their vectors, null ids last; with fewer rows there are fewer entries; equally near entries go to the lower
index. Null labels count together. Components beyond 2^18 in size count as that, so that distances stay exact for parts of up to 16 coordinates; in longer
parts the bound shrinks. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What components are multiplied by; parts; entries of a codebook; rounds; bits of a cell's number; parts searched at once.
SCALE, PARTS, ENTRIES, ROUNDS, BITS, TOGETHER = 1024, 4, 256, 4, 4, 512
#: Bits of the largest sum of squares.
ROOM = 62


def width(size: int, parts: int) -> int:
    """Coordinates of a part of vectors of a length."""
    return -(-size // parts)


def scaled(vectors: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """Vectors (rows) as whole numbers, by row, part and coordinate."""
    n, size = vectors.shape
    each = width(size, parts)
    most = 1 << (ROOM - (max(each, 1) - 1).bit_length()) // 2 - 1
    out = np.zeros((n, parts * each), np.int64)
    out[:, :size] = np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most)
    return out.reshape(n, parts, each)


class Cells:
    """The VA-file of one codebook: borders of cells for each coordinate, and the cells that entries lie in."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, each = entries.shape
        self.cells = 1 << bits
        # cells of about as many entries each; a cell spans from its least to its greatest coordinate
        ranks = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.of = ranks * self.cells // max(n, 1)
        self.low = np.full((each, self.cells), np.iinfo(np.int64).max)
        self.high = np.full((each, self.cells), np.iinfo(np.int64).min)
        for d in range(each):
            np.minimum.at(self.low[d], self.of[:, d], entries[:, d])
            np.maximum.at(self.high[d], self.of[:, d], entries[:, d])
        self.used = self.low <= self.high
        # one row for each coordinate and cell, one column for each entry: a product with it looks all bounds up
        self.member = np.zeros((each * self.cells, n))
        for d in range(each):
            self.member[d * self.cells + self.of[:, d], np.arange(n)] = 1

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest squared distance that each entry may have from each of some parts, a little widened for rounding."""
        x = parts[:, :, None]
        below, above = np.where(self.used, self.low - x, 0), np.where(self.used, x - self.high, 0)
        near = np.maximum(np.maximum(below, above), 0).astype(float)
        far = np.maximum(np.abs(below), np.abs(above)).astype(float)
        near *= near
        far *= far
        n = len(parts)
        return near.reshape(n, -1) @ self.member * (1 - 1e-9), far.reshape(n, -1) @ self.member * (1 + 1e-9)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each part, its squared distance, and how many entries were compared."""
        own, least, compared = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for at in range(0, len(parts), TOGETHER):
            some = parts[at : at + TOGETHER]
            near, far = self.bounds(some)
            row, entry = np.nonzero(near <= far.min(1, keepdims=True))  # by row, then by entry
            gap = some[row] - self.entries[entry]
            distance = (gap * gap).sum(1)
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best = np.minimum.reduceat(distance, first)
            hits = np.flatnonzero(distance == np.repeat(best, np.diff(np.append(first, len(row)))))
            hits = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]  # the lowest index of equals
            own[at : at + TOGETHER], least[at : at + TOGETHER] = entry[hits], best
            compared += len(row)
        return own, least, compared


def _rows(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), size)


def _sums(shared, size: int):
    """For each part and entry, the sums of the coordinates and the number of the parts that are nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(b) for b in shared.value]
        sums, counts = np.zeros(shared.value.shape, np.int64), np.zeros(shared.value.shape[:2], np.int64)
        for batch in batches:
            whole = scaled(_rows(batch.column(0), size), len(books))
            for k, book in enumerate(books):
                own = book.nearest(whole[:, k])[0]
                np.add.at(sums[k], own, whole[:, k])
                counts[k] += np.bincount(own, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        values = sums[part, entry]
        offsets = np.arange(len(part) + 1, dtype=np.int32) * values.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))], ["part", "entry", "n", "sums"])

    return run


def moved(vectors: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks after one round over a column of vectors: each entry that is some part's nearest becomes their mean, rounded down."""
    found = vectors.mapInArrow(_sums(vectors.sparkSession.sparkContext.broadcast(books), size), "part int, entry int, n long, sums array<long>")
    place = F.posexplode("sums").alias("place", "sum")
    totals = found.select("part", "entry", "n", place).groupBy("part", "entry", "place").agg(F.sum(F.col("n").cast("decimal(20,0)")).cast("long").alias("n"), F.sum(F.col("sum").cast("decimal(20,0)")).cast("string").alias("sum"))
    out = books.copy()
    for part, entry, at, n, total in totals.collect():  # as many rows as the codebooks have numbers
        out[part, entry, at] = int(total) // n
    return out


def first_books(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[np.ndarray, int]:
    """Codebooks of the parts of the vectors with the smallest ids, and the vectors' length."""
    top = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    size = len(top[0]["v"]) if top else 0
    rows = kept.where(F.size("v") == size).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    found = scaled(np.array([r["v"] for r in rows], float).reshape(len(rows), size), parts)
    return np.ascontiguousarray(found.transpose(1, 0, 2)), size


def digest(books: np.ndarray) -> str:
    """sha256 of the decimal numbers of all entries by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _codes(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Cells(b) for b in shared.value]
        digits = 2 * max(1, math.ceil((shared.value.shape[1] - 1).bit_length() / 8))
        hexes = np.array([f"{k:0{digits}x}" for k in range(max(shared.value.shape[1], 1))], object)
        for batch in batches:
            whole = scaled(_rows(batch.column(1), size), len(books))
            codes, error, compared = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64), 0
            for k, book in enumerate(books):
                own, least, n = book.nearest(whole[:, k])
                codes, error, compared = codes + hexes[own], error + least, compared + n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code (hex digits for each part), error (squared distance to the code's entries), label_error (summed over the rows of a label) and codebooks_sha256 of every kept vector."""
    spark = vectors.sparkSession
    common.tune(spark)
    vector = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), F.col(label_col).alias("label"))
    books, size = first_books(kept, parts, entries)
    kept = kept.where(F.size("v") == size)
    for _ in range(rounds):
        books = moved(kept.select("v"), books, size)
    label = dict(kept.dtypes)["label"]
    coded = common.saved(kept.mapInArrow(_codes(spark.sparkContext.broadcast(books), size), f"vec_id long, label {label}, code string, error long"), "codes")
    # one row for each label, dealt anew on both sides: a label that holds very many rows can be split, and few labels are sent to all
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    totals = totals.select(F.col("label").alias("_label"), F.least("total", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))

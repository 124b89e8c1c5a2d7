"""What the operators of this subpackage share: Arrow batches, id filters, samples, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.scratch import drop, saved, saved_alone, scratch, scratch_path, shared_dir  # noqa: F401
from textloom.session import BATCH_BYTES, BATCH_ROWS, bounded  # noqa: F401
from textloom.shipping import ship

#: Python's bytes.split() cuts at exactly these: the words are [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"


def tune(spark: SparkSession) -> None:
    """Send the package to the executors and bound the Arrow batches by bytes, since texts may be very long."""
    ship(spark)
    bounded(spark)


def redealt(df: DataFrame, key: str) -> DataFrame:
    """The frame with its whole-number key computed anew. An aggregate by a key is already dealt by it, and a join would take it as it lies, so that a hot key's rows on the other side couldn't be split; dealt again, adaptive execution can split them."""
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


#: Bits of an id filter, and tasks that fill it: both fixed, so that what is broadcast and sent to the driver is bounded.
FILTER_BITS, FILTER_TASKS = 1 << 24, 8


def _filter_places(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return tuple(((mixed >> np.uint64(k)) % np.uint64(FILTER_BITS)).astype(np.int64) for k in (0, 20, 40))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for places in _filter_places(batch.column(0).to_numpy(zero_copy_only=False)):
            bits[places] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])


def may_be_in(ids: DataFrame, column: Column) -> Column:
    """A condition that holds for every row whose id is in a frame of one column of ids, and for few others: a Bloom filter of fixed size. Rows outside it needn't be shuffled to be joined; if the ids are very many it lets all through, and the join that must follow decides alone. False for null."""
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    known = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).where("id is not null")
    for row in known.repartition(FILTER_TASKS).mapInArrow(_fill, "bits binary").toLocalIterator():
        bits |= np.frombuffer(row["bits"], np.uint8)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def holds(values: pa.Array) -> pa.Array:
        found = np.ones(len(values), bool)
        for places in _filter_places(values.to_numpy(zero_copy_only=False)):
            found &= (shared.value[places >> 3] >> (7 - (places & 7)) & 1).astype(bool)
        return pa.array(found)

    return column.isNotNull() & holds(F.coalesce(column.cast("long"), F.lit(0).cast("long")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, with Arrow batches bounded."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: int | None, modulus: int) -> int:
    """crc32 of the id as text, modulo; -1 for a null id, which is thus never 0."""
    return -1 if doc_id is None else zlib.crc32(b"%d" % doc_id) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether the row is kept from learning; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == 0, F.lit(False))


def hash_limit(rows: int, total: int) -> int:
    """What a 64-bit hash is at most for about `rows` of `total` rows, of whatever number."""
    return (1 << 63) - 1 if total <= rows else -(1 << 63) + ((1 << 64) - 1) * rows // total


def hash_fraction(df: DataFrame, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, distinct ones, chosen by a hash of all their columns: the same whatever the partitioning, and a bound even if one id or one row is repeated without end."""
    return (df if total <= rows else df.where(F.xxhash64(*df.columns, F.lit(97)) <= F.lit(hash_limit(rows, total)))).distinct()


#: What empties the memories that operators keep in a Python worker, by operator.
_MEMORIES: dict[str, Callable[[], object]] = {}


def remembering(name: str, forget: Callable[[], object]) -> None:
    """Called by a task that goes on to use a memory of its worker, which runs many tasks: the memories of other operators go, so that a worker holds one at a time."""
    for other, empty in _MEMORIES.items():
        if other != name:
            empty()
    _MEMORIES[name] = forget


def released() -> None:
    """Give memory that isn't used any more back to the system, where its C library can: workers stay when their task is over."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without passes of the cycle collector, for code that makes many objects and no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Some batches after each other as one, for work that gains from more rows at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if len(held) == size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def text_of(column: pa.Array) -> list[str]:
    """Python strings of a text column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text without a decoding step, null as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for x in column:
        yield x.as_py() or b""

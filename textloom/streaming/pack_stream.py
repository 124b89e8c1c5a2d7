"""Packing a stream of documents, with state that outlives the files it arrives in."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom import scratch
from textloom.shipping import ship
from textloom.sources.files import is_file

#: Rows of an arrival, about; rows of one key stay together.
ARRIVAL_ROWS = 1_000_000


def document_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1, delete_consumed: bool = False) -> DataFrame:
    """Parquet files as they arrive, a few to a batch; consumed ones may be deleted. A single file is a folder of one."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, folder):
        folder, name = folder.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if delete_consumed:
        reader = reader.option("cleanSource", "delete")
    return reader.parquet(folder)


def pack_stream(lengths: DataFrame, block: int, stream: str = "stream") -> DataFrame:
    """(stream, doc_id, n, pack, place) of arriving rows (stream, doc_id, n): next-fit packing whose open pack is kept as state across batches; within a batch documents come in order of their ids. Pieces of documents have a chunk, which follows doc_id in the order and the result."""
    ship(lengths.sparkSession)
    chunk = ["chunk"] if "chunk" in lengths.columns else []

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pack, used = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(["doc_id", *chunk])
        packs, places = [], []
        for n in rows["n"]:
            if used + n > block and used:
                pack, used = pack + 1, 0
            packs.append(pack)
            places.append(used)
            used += int(n)
        state.update((pack, used))
        yield pd.DataFrame({"stream": key[0], "doc_id": rows["doc_id"], **{c: rows[c] for c in chunk}, "n": rows["n"], "pack": packs, "place": places})

    return lengths.groupBy(stream).applyInPandasWithState(step, f"stream string, doc_id long, {'chunk long, ' if chunk else ''}n long, pack long, place long", "pack long, used long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write all that has arrived to Parquet, batch by batch, and read it; a later call with the same checkpoint goes on from there."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def arrivals(rows: DataFrame, order: str, folder: str, most: int = ARRIVAL_ROWS) -> Iterator[int]:
    """Writes a table into a folder as files that arrive one after the other, a range of a whole-number key in each, lowest first and null last; yields after each. So a stream meets the rows in the key's order, however the table's own files are cut, and what a batch holds is bounded."""
    spark = rows.sparkSession
    parts = -(-rows.count() // most)
    bounds = sorted({int(b) for b in rows.approxQuantile(order, [k / parts for k in range(1, parts)], 1 / (4 * parts))}) if parts > 1 else []
    place = reduce(lambda a, b: a + b, [(F.col(order) > b).cast("int") for b in bounds], F.lit(0))
    staged = scratch.scratch_path(spark, "arrivals")
    rows.withColumn("_arrival", F.coalesce(F.when(F.col(order).isNotNull(), place), F.lit(len(bounds)))).repartition("_arrival").write.partitionBy("_arrival").parquet(staged)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _arrival int"
    for k in range(len(bounds) + 1):
        spark.read.schema(schema).parquet(staged).where(F.col("_arrival") == k).drop("_arrival").coalesce(1).write.mode("append").parquet(folder)
        yield k

"""A kept dictionary of encodings: each distinct chunk is encoded once, in whatever run meets it first.

The dictionary is a table (chunk, ids) below a folder, under the fingerprint of its vocabulary. A
run looks for chunks that aren't in it, encodes these alone and adds them; ids come back by a join. Frequent chunks are
broadcast, in bounded number, so that a chunk of most texts is no hot key. One run adds to a dictionary at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import scratch
from textloom.functions import text as T
from textloom.operators import bpe
from textloom.session import bounded
from textloom.shipping import ship

#: Chunks that are broadcast at most, and their bytes.
HEAD, LONGEST = 100_000, 64
ENTRY = "chunk string, ids array<int>"


def fingerprint(vocabulary: bpe.Vocabulary) -> str:
    """The same for vocabularies that encode alike."""
    typed = [t if isinstance(t, str) else t.hex() for t in vocabulary.tokens]
    return hashlib.sha256(json.dumps([vocabulary.mode, typed, sorted(vocabulary.merges.items()), vocabulary.specials]).encode()).hexdigest()


def path_of(folder: str, vocabulary: bpe.Vocabulary) -> str:
    return f"{folder.rstrip('/')}/{fingerprint(vocabulary)}"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary; empty if there is none yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(ENTRY).parquet(path) if there else spark.createDataFrame([], ENTRY)


def extend(chunks: DataFrame, vocabulary: bpe.Vocabulary, path: str) -> int:
    """Encode those of the distinct chunks (chunk) that the dictionary lacks, and add them. Returns how many there were."""
    spark = chunks.sparkSession
    ship(spark)
    bounded(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = [own.encode_chunk(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["chunk", "ids"])

    known = read(spark, path)
    before = known.count()
    new = chunks.where(F.col("chunk").isNotNull()).join(known.select("chunk"), "chunk", "left_anti")
    if new.isEmpty():
        return 0
    new.mapInArrow(run, ENTRY).write.mode("append").parquet(path)
    return read(spark, path).count() - before


def _frequent(counts: DataFrame) -> DataFrame:
    """The chunks (chunk) of the highest counts, as many whole counts as stay within the bound; long ones aside."""
    short = counts.where(F.octet_length("chunk") <= LONGEST)
    total, least = 0, None
    for n, size in short.groupBy("cnt").count().orderBy(F.desc("cnt")).limit(HEAD).toLocalIterator():
        if total + size > HEAD:
            break
        total, least = total + size, n
    return short.where(F.lit(False) if least is None else F.col("cnt") >= least).select("chunk")


def token_counts(docs: DataFrame, vocabulary: bpe.Vocabulary, folder: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """The frame with the number of each text's tokens, by way of the dictionary, which is extended first; null for a null text. A text's chunks are counted before they are looked up."""
    path = path_of(folder, vocabulary)
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    chunks = rows.select("_row", F.explode(T.pretokens(F.col(text_col), vocabulary.mode, tuple(vocabulary.specials))).alias("chunk"))
    # texts are cut twice: to count their chunks, and to look these up
    counts = scratch.saved(chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("cnt")), "chunk-counts")
    extend(counts.select("chunk"), vocabulary, path)
    entries = read(docs.sparkSession, path).select("chunk", F.size("ids").alias("_size"))
    head = entries.join(_frequent(counts), "chunk", "left_semi")
    rare = F.when(F.col("_size").isNull(), F.col("chunk")).alias("chunk")
    looked = chunks.join(F.broadcast(head), "chunk", "left").select("_row", rare, F.coalesce("_size", F.lit(0)).alias("_size"))
    found = scratch.saved(looked.groupBy("_row", "chunk").agg(F.count(F.lit(1)).alias("_times"), F.sum("_size").alias("_n")), "looked-up")
    scratch.drop(counts)
    rest = found.where("chunk is not null").join(entries, "chunk").select("_row", (F.col("_times") * F.col("_size")).alias("_n"))
    totals = found.where("chunk is null").select("_row", "_n").unionByName(rest).groupBy("_row").agg(F.sum("_n").alias("_n"))
    total = F.when(F.col(text_col).isNotNull(), F.coalesce("_n", F.lit(0)))
    return rows.join(totals, "_row", "left").withColumn(out, total.cast("long")).drop("_row", "_n")

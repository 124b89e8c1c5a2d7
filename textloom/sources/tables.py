"""Tables, metrics, text and token shards as frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shipping import ship
from textloom.sources import shard_files
from textloom.sources.files import qualified

#: Rows of training and validation metrics in one file, with the keys of either.
METRICS = "step long, t_loss double, lr double, tokens long, grad_norm double, clip_ratio double, param_norm double, v_loss double"
EVALUATION = "question string, answers array<string>, label int"


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table; only the columns asked for are read. An absent one is an error."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (text) for each line of text files: for counting."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row (text) for each text file: for encoding."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def chats(spark: SparkSession, path: str) -> DataFrame:
    """Chat rows with at least one message."""
    return spark.read.parquet(path).where(F.size("messages") > 0)


def write_evaluation(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write (question, answers, label) with the fixed types."""
    df.select(F.col("question").cast("string").alias("question"), F.col("answers").cast("array<string>").alias("answers"), F.col("label").cast("int").alias("label")).write.mode(mode).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows; blank lines are passed over."""
    return spark.read.schema(METRICS).json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """(name, tokens array<int>) of files of little-endian unsigned 16-bit ids without a header."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["name", "tokens"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, tokens array<int>")


def write_token_shards(rows: DataFrame, folder: str, order: str = "doc_id", overwrite: bool = True) -> DataFrame:
    """Write rows (shard, order, tokens) as one .bin file for each shard, in order, all or none (shard_files); returns (name, n_tokens) by the manifest. Ids must be below 65,536. folder: an address that pyarrow's file systems open on every executor; a bare path lies in Spark's default file system."""
    spark, folder = _with_shards(rows.sparkSession, folder)
    ordered = rows.select("shard", order, "tokens").repartition("shard").sortWithinPartitions("shard", order).select(F.col("shard").cast("int").alias("shard"), F.col("tokens").cast("array<int>").alias("tokens"))
    ordered.write.format("token_shards").mode("overwrite" if overwrite else "append").option("path", folder).save()
    return spark.createDataFrame([*shard_files.committed(folder).items()], "name string, n_tokens long")


def _with_shards(spark: SparkSession, folder: str) -> tuple[SparkSession, str]:
    """The session with the data source of token shards, and the folder with its file system."""
    ship(spark)
    spark.dataSource.register(shard_files.TokenShards)
    return spark, qualified(spark, folder)


def read_shard_documents(spark: SparkSession, folder: str, delimiter: int, range_bytes: int = shard_files.RANGE_BYTES) -> DataFrame:
    """(name, start, tokens array<int>): the documents of a folder of token shards, each with its delimiter and the place of that in its file. Large files are read by several tasks."""
    spark, folder = _with_shards(spark, folder)
    return spark.read.format("token_shards").option("path", folder).option("delimiter", delimiter).option("range_bytes", range_bytes).load()


def shard_metadata(counts: DataFrame, vocab_path: str, split_id: int, **more) -> dict:
    """The manifest of a folder of shards, from (name, n_tokens), which has a row for each shard."""
    found = {r["name"]: r["n_tokens"] for r in counts.orderBy("name").collect()}
    return {"num_shards": len(found), "vocab_path": vocab_path, "split_id": split_id, "token_counts": found} | more


def shard_names(n: int) -> list[str]:
    return [f"shard_{i:04d}.bin" for i in range(n)]



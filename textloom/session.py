"""Session defaults for tests and benchmarks; a cluster brings its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes and rows of one Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bounded(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, since texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def local_session(cpus: str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow batches bounded by bytes."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
    )
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()

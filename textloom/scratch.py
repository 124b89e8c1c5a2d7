"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application; they go when the driver ends.
_LOCAL_DIRS: dict[str, str] = {}
#: Scratch paths of the innermost scratch() that is open, if any.
_OWNED: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. A local session, whose executors are the driver, may do without; a cluster may not. No setting is changed."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = folder = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, folder, True)
    return "file://" + _LOCAL_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder, owned by the innermost scratch() that is open."""
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Owns the scratch tables made within: they are removed at its end, so results must have been read or written by then. Outside of it, the caller removes what results still read."""
    _OWNED.append([])
    try:
        yield _OWNED[-1]
    finally:
        for path in _OWNED.pop():
            _remove(spark, path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def saved_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """saved(make()), and of the scratch tables made for it nothing stays but this one."""
    path = scratch_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove scratch tables made by saved() that no later plan reads."""
    for df in frames:
        _remove(df.sparkSession, df._scratch)

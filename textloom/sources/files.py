"""Small text files through the cluster's file systems: vocabularies, manifests, status."""

from __future__ import annotations

import base64
import json

from pyspark.sql import SparkSession

from textloom.functions import text as T
from textloom.operators.bpe import Vocabulary


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system; a bare one lies in the default file system, as for all of Spark's readers and writers."""
    where, fs = _place(spark, path)
    return fs.makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    where, fs = _place(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def write_text(spark: SparkSession, path: str, text: str, exclusive: bool = False) -> None:
    """Write under a temporary name and rename, so that a reader never sees a part. exclusive: an existing file is an error."""
    where, fs = _place(spark, path)
    if exclusive and fs.exists(where):
        raise FileExistsError(path)
    part = spark._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise FileNotFoundError(path)
    return rows[0][0]


def save_vocabulary(spark: SparkSession, vocabulary: Vocabulary, path: str) -> str:
    """Write a new .json file; byte tokens are in base64. The path is returned, with the suffix it gets."""
    path = path if path.endswith(".json") else path + ".json"
    tokens = [base64.b64encode(t).decode() for t in vocabulary.tokens] if vocabulary.mode == T.BYTES else vocabulary.tokens
    config = {"mode": vocabulary.mode, "vocab_size": len(vocabulary.tokens), "special_tokens": vocabulary.specials, "pattern": "|".join(T.ALTERNATIVES)}
    write_text(spark, path, json.dumps({"config": config, "tokens": tokens, "merges": {str(k): list(v) for k, v in vocabulary.merges.items()}}), exclusive=True)
    return path


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    found = json.loads(read_text(spark, path))
    if "merges" not in found:
        raise ValueError(f"{path} has no merges: it can't encode")
    mode = found["config"]["mode"]
    tokens = [base64.b64decode(t) for t in found["tokens"]] if mode == T.BYTES else found["tokens"]
    return Vocabulary(mode, tokens, {int(k): tuple(v) for k, v in found["merges"].items()}, found["config"]["special_tokens"])


def load_json(spark: SparkSession, path: str, default: dict | None = None) -> dict:
    """A manifest or status file, or the default if there is none."""
    return json.loads(read_text(spark, path)) if default is None or exists(spark, path) else dict(default)


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, indent=2))


#: What a run's status begins with.
NEW_STATUS = {"step": 0, "shards_consumed": 0, "best_val_loss": float("inf"), "status": "running", "dataset_shards": {}}


def update_status(spark: SparkSession, path: str, **changes) -> dict:
    """Change some fields of a run's status; unknown fields are an error."""
    unknown = set(changes) - set(NEW_STATUS)
    if unknown:
        raise ValueError(f"no such status field: {sorted(unknown)[0]}")
    status = load_json(spark, path, NEW_STATUS) | changes
    save_json(spark, path, status)
    return status

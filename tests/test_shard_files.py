"""Token shards: ranges against whole files, and commits against tasks that fail or come twice."""

import io
import os
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.sources import shard_files, tables


def whole(ids, delimiter=0):
    """Documents of a file by one look at all of it."""
    at = [k for k, x in enumerate(ids) if x == delimiter]
    return [(a, list(ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)])]


def ranged(ids, size, step):
    data = np.asarray(ids, "<u2").tobytes()
    out = []
    for low in range(0, len(data), size):
        for batch in shard_files.documents(io.BytesIO(data), "x", low, min(low + size, len(data)), len(data), 0, step):
            out += list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    return out


@given(st.lists(st.sampled_from([0, 1, 2, 65535]), max_size=60), st.sampled_from([2, 4, 10, 64, 200]), st.sampled_from([2, 6, 32, 400]))
def test_ranges_hold_whole_documents(ids, size, step):
    assert ranged(ids, size, step) == whole(ids)


def rows(spark, n=300):
    ids = F.transform(F.sequence(F.lit(0), F.pmod("doc_id", F.lit(7)).cast("int")), lambda k: F.when(k == 0, 0).otherwise(k * 9000 + 1))
    return spark.range(n).select(F.col("id").alias("doc_id")).select("doc_id", F.pmod("doc_id", F.lit(3)).cast("int").alias("shard"), ids.alias("tokens"))


def test_write_and_read_by_ranges(spark, tmp_path):
    folder = str(tmp_path / "s")
    counts = {r["name"]: r.n_tokens for r in tables.write_token_shards(rows(spark), folder).collect()}
    found = tables.read_shard_documents(spark, folder, 0, range_bytes=64)
    assert found.rdd.getNumPartitions() >= 8
    got = sorted((r["name"], r.start, r.tokens) for r in found.collect())
    want = [(r["name"], at, ids) for r in tables.read_token_shards(spark, folder).collect() for at, ids in whole(r.tokens)]
    assert got == sorted(want) and len(got) == 300
    assert counts == {name: sum(len(t) for n, _, t in got if n == name) for name in counts}
    assert sorted(os.listdir(folder)) == [shard_files.MANIFEST, *sorted(counts)]


def test_failed_write_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "s")
    tables.write_token_shards(rows(spark), folder)
    before = sorted((r["name"], r.start, r.tokens) for r in tables.read_shard_documents(spark, folder, 0).collect())
    bad = rows(spark).withColumn("tokens", F.when(F.col("doc_id") == 250, F.array(F.lit(70_000))).otherwise(F.array(F.lit(0))))
    with pytest.raises(Exception, match="16 bits"):
        tables.write_token_shards(bad, folder)
    assert sorted((r["name"], r.start, r.tokens) for r in tables.read_shard_documents(spark, folder, 0).collect()) == before
    assert not any(x.startswith(shard_files.ATTEMPTS) for x in os.listdir(folder))
    with pytest.raises(Exception, match="holds shards"):
        tables.write_token_shards(rows(spark), folder, overwrite=False)
    # fewer shards: those of before go
    tables.write_token_shards(rows(spark).where("shard = 1"), folder)
    assert sorted(os.listdir(folder)) == [shard_files.MANIFEST, "shard_0001.bin"]


def batches(*some):
    import pyarrow as pa

    yield from (pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(t, pa.list_(pa.int32()))], ["shard", "tokens"]) for s, t in some)


def test_only_attempts_that_count_are_kept(tmp_path):
    """A task that ran twice, one that was killed half-way, and one without rows."""
    folder = str(tmp_path / "s")
    writer = shard_files.ShardWriter(folder, True)
    first = writer.write(batches(([0, 0], [[0, 1], None]), ([0, 2], [[7], [0]])))
    writer.write(batches(([0], [[0, 1, 5, 5, 5]]), ([2], [[0]])))  # its message is never used
    with pytest.raises(ValueError):
        writer.write(batches(([1], [[0]]), ([1, 0, 1], [[0], [0], [0]])))
    writer.commit([first, None, writer.write(batches())])
    assert shard_files.committed(folder) == {"shard_0000.bin": 3, "shard_0002.bin": 1}
    assert np.fromfile(f"{folder}/shard_0000.bin", "<u2").tolist() == [0, 1, 7]
    assert sorted(os.listdir(folder)) == [shard_files.MANIFEST, "shard_0000.bin", "shard_0002.bin"]
    again = shard_files.ShardWriter(folder, True)
    with pytest.raises(ValueError, match="two tasks"):
        again.commit([again.write(batches(([0], [[0]]))), again.write(batches(([0], [[0]])))])
    assert shard_files.committed(folder) == {"shard_0000.bin": 3, "shard_0002.bin": 1}


def test_a_broken_off_commit_is_noticed(tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    writer = shard_files.ShardWriter(folder, True)
    writer.commit([writer.write(batches(([0], [[0, 1]])))])
    broken = shard_files.ShardWriter(folder, True)
    message = broken.write(batches(([0, 1], [[0], [0]])))
    monkeypatch.setattr(shard_files.json, "dumps", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        broken.commit([message])
    broken.abort([message])
    monkeypatch.undo()
    with pytest.raises(ValueError, match="broken off"):
        shard_files.ShardReader(folder, 0, 64).partitions()
    writer = shard_files.ShardWriter(folder, True)
    writer.commit([writer.write(batches(([3], [[0, 9]])))])
    assert shard_files.committed(folder) == {"shard_0003.bin": 2}
    assert [p.path.rsplit("/")[-1] for p in shard_files.ShardReader(folder, 0, 64).partitions()] == ["shard_0003.bin"]
    with open(f"{folder}/shard_0003.bin", "ab") as f:
        f.write(b"xx")
    with pytest.raises(ValueError, match="manifest"):
        shard_files.ShardReader(folder, 0, 64).partitions()


def test_folders_without_a_manifest(tmp_path):
    assert shard_files.committed(str(tmp_path)) == {}
    np.array([5, 0, 1], "<u2").tofile(tmp_path / "a.bin")
    (tmp_path / "b.txt").write_text("x")
    assert [(os.path.basename(p.path), p.low, p.high) for p in shard_files.ShardReader(str(tmp_path), 0, 4).partitions()] == [("a.bin", 0, 4), ("a.bin", 4, 6)]
    (tmp_path / "empty").mkdir()
    reader = shard_files.ShardReader(str(tmp_path / "empty"), 0, 4)
    assert [list(reader.read(p)) for p in reader.partitions()] == [[]]


#: A cluster of this machine whose shared folder is named by a bare path.
BARE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from textloom.plans import catalogue
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.checkpoint.dir": sys.argv[2], "spark.local.dir": sys.argv[2] + "-local", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
print("rows", catalogue.QUERIES["token_shards"](spark, sys.argv[3]).count())
spark.stop()
"""


def test_shared_folder_without_file_system(tmp_path, data):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_GATEWAY"))} | {"SPARK_WORKER_DIR": f"{tmp_path}/work"}
    done = subprocess.run([sys.executable, "-c", BARE, root, f"{tmp_path}/shared", data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import bpe
from textloom.plans import config, prepare
from textloom.sources import files, tables
from textloom.streaming import pack_stream


def test_vocabulary_round_trip(spark, tmp_path):
    v = bpe.Vocabulary("bytes", [bytes([b]) for b in range(256)] + [b"ab", b"<X>"], {256: (97, 98)}, ["<X>"])
    path = files.save_vocabulary(spark, v, str(tmp_path / "v"))
    assert path.endswith(".json")
    assert files.load_vocabulary(spark, path) == v
    with pytest.raises(FileExistsError):
        files.save_vocabulary(spark, v, path)
    files.write_text(spark, str(tmp_path / "old.json"), json.dumps({"config": {"mode": "str"}, "tokens": []}))
    with pytest.raises(ValueError):
        files.load_vocabulary(spark, str(tmp_path / "old.json"))


def test_status(spark, tmp_path):
    path = str(tmp_path / "status.json")
    assert files.update_status(spark, path, step=3)["best_val_loss"] == float("inf")
    assert files.update_status(spark, path, best_val_loss=1.5)["step"] == 3
    with pytest.raises(ValueError):
        files.update_status(spark, path, steps=1)


def test_token_shards_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, 2, [5, 6]), (0, 1, [1]), (1, 1, [65535])], "shard int, doc_id long, tokens array<int>")
    out = tables.write_token_shards(rows, str(tmp_path / "s"))
    assert {r["name"]: r.n_tokens for r in out.collect()} == {"shard_0000.bin": 3, "shard_0001.bin": 1}
    assert {r["name"]: r.tokens for r in tables.read_token_shards(spark, str(tmp_path / "s")).collect()} == {"shard_0000.bin": [1, 5, 6], "shard_0001.bin": [65535]}


def test_metrics_and_config(spark, tmp_path):
    path = str(tmp_path / "m")
    tables.append_metrics(spark.createDataFrame([(1, 2.0)], "step long, t_loss double"), path)
    tables.append_metrics(spark.createDataFrame([(1, 3.0)], "step long, v_loss double"), path)
    assert tables.read_metrics(spark, path).where("v_loss is not null").count() == 1
    base = {"dataset": {"dataset_folders": ["a", "b"], "dataset_weights": [1, 3]}, "tokens": {"batch_size": 8, "grad_accum_steps": 2, "block_size": 4, "total_tokens": 640}}
    files.save_json(spark, str(tmp_path / "c.json"), base)
    r = config.with_steps(config.read(spark, str(tmp_path / "c.json"))).first()
    assert (r.steps, r.per_step, list(r.dataset.dataset_weights), r.run.seed) == (10, 64, [0.25, 0.75], 42)
    base["tokens"]["total_steps"] = 3
    files.save_json(spark, str(tmp_path / "d.json"), base)
    with pytest.raises(Exception, match="either"):
        config.with_steps(config.read(spark, str(tmp_path / "d.json"))).collect()


def test_corpus_run(spark, tmp_path, data, capsys):
    args = [f"{data}/documents.parquet", str(tmp_path / "out"), "--vocab_size", "300", "--n_output_shards", "3"]
    prepare.main(["corpus", *args, "--verify"])
    meta = files.load_json(spark, str(tmp_path / "out/shards/metadata.json"))
    assert meta["val_shard"] == "shard_0002.bin" and len(meta["train_shards"]) == 2
    rows = prepare.verify(spark, str(tmp_path / "out")).collect()
    assert all(r.n_tokens == r.recorded for r in rows) and sum(r.n_docs for r in rows) == 200
    prepare.main(["corpus", *args])
    assert files.load_json(spark, str(tmp_path / "out/status.json"))["phases_complete"] == ["tokenize", "shuffle"]


def test_chat_and_eval_runs(spark, tmp_path):
    chats = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],), ([],)], "messages array<struct<role: string, content: string>>")
    chats.write.parquet(str(tmp_path / "chats"))
    args = prepare.parser().parse_args(["chat", str(tmp_path / "chats"), str(tmp_path / "o")])
    assert [r.text for r in prepare.chat_texts(spark, args).collect()] == ["<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>"]
    spark.createDataFrame([("q", ["a"], "0")], "ctx string, endings array<string>, label string").write.parquet(str(tmp_path / "e"))
    prepare.main(["eval", str(tmp_path / "e"), str(tmp_path / "norm")])
    assert spark.read.parquet(str(tmp_path / "norm")).schema.simpleString() == "struct<question:string,answers:array<string>,label:int>"


def test_stream_state_outlives_files(spark, tmp_path):
    rows = spark.range(40).select(F.lit("s").alias("stream"), F.col("id").alias("doc_id"), F.lit(3).cast("long").alias("n"))
    for low, part in ((0, "a"), (20, "b")):
        rows.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = pack_stream.document_stream(spark, str(tmp_path / "in"), rows.schema)
        out = pack_stream.run_to_end(pack_stream.pack_stream(stream, 7), str(tmp_path / "out"), str(tmp_path / "state"))
    packs = out.groupBy("pack").agg(F.sum("n").alias("n")).collect()
    assert len(packs) == 20 and all(r.n == 6 for r in packs)


def test_text_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a\nb\n")
    assert tables.text_lines(spark, str(tmp_path / "t.txt")).count() == 2
    assert tables.whole_texts(spark, str(tmp_path / "t.txt")).first().text == "a\nb\n"

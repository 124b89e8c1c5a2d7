"""Whole runs from the command line: corpora, chats and evaluations.

    python -m textloom.plans.prepare corpus IN OUT [options]
    python -m textloom.plans.prepare chat IN OUT [options]
    python -m textloom.plans.prepare eval IN OUT [--question_col Q --answer_col A --label_col L | --kind arc|winogrande]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import bpe, corpus, evals, shards
from textloom.sources import files, tables


def _phase(spark: SparkSession, out: str, name: str, force: bool) -> bool:
    """Whether a phase is still to be done."""
    done = {} if force else files.load_json(spark, f"{out}/status.json", {"phases_complete": []})
    return name not in done.get("phases_complete", [])


def _complete(spark: SparkSession, out: str, name: str, **more) -> None:
    status = files.load_json(spark, f"{out}/status.json", {"phases_complete": []})
    status["phases_complete"] = [*dict.fromkeys([*status["phases_complete"], name])]
    files.save_json(spark, f"{out}/status.json", status | more)


def corpus_texts(spark: SparkSession, args: argparse.Namespace, first_files: int | None = None) -> DataFrame:
    """(doc_id, text) of the chosen files, filtered by score."""
    rows = spark.read.parquet(args.input)
    rows = corpus.file_subset(rows, indices=args.shard_indices, first=first_files or args.max_shards) if args.shard_indices or first_files or args.max_shards else rows
    if args.min_score:
        rows = corpus.score_at_least(rows, args.min_score[0], float(args.min_score[1]))
    key = F.col("doc_id") if "doc_id" in rows.columns else F.xxhash64("text")
    return rows.where(F.col("text").isNotNull()).select(key.cast("long").alias("doc_id"), "text")


def chat_texts(spark: SparkSession, args: argparse.Namespace, first_files: int | None = None) -> DataFrame:
    """(doc_id, text) of rendered chats; empty ones go."""
    rows = tables.chats(spark, args.input)
    rows = corpus.file_subset(rows, first=first_files or args.max_shards) if first_files or args.max_shards else rows
    return rows.select(T.chatml(F.col("messages")).alias("text")).select(F.xxhash64("text").alias("doc_id"), "text")


def prepare(spark: SparkSession, args: argparse.Namespace, texts=corpus_texts) -> dict:
    """Train or load the vocabulary, encode, scatter, split, write and verify; phases that are complete are skipped."""
    out = args.output
    vocab_path = args.vocab_path or f"{out}/vocab.json"
    if not files.exists(spark, vocab_path):
        counts = corpus.chunk_counts(texts(spark, args, args.vocab_train_shards), T.BYTES, tuple(args.special_tokens))
        files.save_vocabulary(spark, bpe.train(counts, args.vocab_size, args.special_tokens), vocab_path)
    vocabulary = files.load_vocabulary(spark, vocab_path)
    missing = [s for s in [args.bos_token, *args.special_tokens] if vocabulary.typed(s) not in vocabulary.index]
    if missing:
        raise ValueError(f"the vocabulary lacks {missing[0]}")
    bos = vocabulary.id_of(args.bos_token)
    if not args.skip_tokenize and _phase(spark, out, "tokenize", args.force):
        encoded = bpe.encode(texts(spark, args), vocabulary, out="tokens", bos=args.bos_token).select("doc_id", "tokens")
        encoded.write.mode("overwrite").parquet(f"{out}/encoded")
        _complete(spark, out, "tokenize")
    encoded = spark.read.parquet(f"{out}/encoded")
    if not args.skip_shuffle and _phase(spark, out, "shuffle", args.force):
        total = encoded.agg(F.sum(F.size("tokens"))).first()[0] or 0
        n = args.n_output_shards or max(1, -(-total // args.shard_size))
        train, val = shards.split_names(n, args.val_shards)
        placed = shards.scattered(encoded, n, args.seed).withColumn("_order", T.md5_number(F.lit(args.seed), F.lit("order"), F.col("doc_id")))
        written = tables.write_token_shards(placed, f"{out}/shards", "_order").collect()  # a row for each shard
        counts = {name: 0 for name in tables.shard_names(n)} | {r["name"]: r["n_tokens"] for r in written}
        meta = {"num_shards": n, "vocab_path": vocab_path, "split_id": bos, "shuffled": True, "seed": args.seed, "train_shards": train, "val_shard": val, "token_counts": counts}
        files.save_json(spark, f"{out}/shards/metadata.json", meta)
        _complete(spark, out, "shuffle")
    return files.load_json(spark, f"{out}/shards/metadata.json", {})


def verify(spark: SparkSession, out: str, first: int = 3) -> DataFrame:
    """(name, n_tokens, n_docs, recorded) of the first shards: counts must match the manifest."""
    meta = files.load_json(spark, f"{out}/shards/metadata.json")
    rows = tables.read_token_shards(spark, f"{out}/shards").where(F.col("name").isin(*sorted(meta["token_counts"])[:first]))
    recorded = spark.createDataFrame([(k, v) for k, v in meta["token_counts"].items()], "name string, recorded long")
    return rows.select("name", F.size("tokens").cast("long").alias("n_tokens"), shards.delimiter_count(F.col("tokens"), meta["split_id"]).alias("n_docs")).join(F.broadcast(recorded), "name")


def prepare_eval(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    if args.kind == "arc":
        rows = evals.science_choices(rows)
    elif args.kind == "winogrande":
        rows = evals.fill_in_choices(rows)
    else:
        rows = evals.normalized(rows, args.question_col, args.answer_col, args.label_col)
    tables.write_evaluation(rows, args.output, "ignore" if args.skip_existing else "errorifexists")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom")
    kinds = top.add_subparsers(dest="command", required=True)
    for name in ("corpus", "chat"):
        p = kinds.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        p.add_argument("--shard_indices", type=int, nargs="*")
        p.add_argument("--max_shards", type=int)
        p.add_argument("--vocab_size", type=int, default=32_768)
        p.add_argument("--special_tokens", nargs="*", default=["<BOS>", "<PAD>"] if name == "corpus" else ["<BOS>", "<PAD>", "<|im_start|>", "<|im_end|>"])
        p.add_argument("--bos_token", default="<BOS>")
        p.add_argument("--vocab_path")
        p.add_argument("--vocab_train_shards", type=int)
        p.add_argument("--shard_size", type=int, default=128_000_000)
        p.add_argument("--n_output_shards", type=int)
        p.add_argument("--val_shards", type=int, default=1)
        p.add_argument("--seed", type=int, default=42)
        p.add_argument("--min_score", nargs=2, metavar=("COLUMN", "THRESHOLD"))
        for flag in ("--skip_tokenize", "--skip_shuffle", "--verify", "--force"):
            p.add_argument(flag, action="store_true")
    p = kinds.add_parser("eval")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--kind", choices=("generic", "arc", "winogrande"), default="generic")
    p.add_argument("--question_col", default="ctx")
    p.add_argument("--answer_col", default="endings")
    p.add_argument("--label_col", default="label")
    p.add_argument("--skip_existing", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "eval":
        prepare_eval(spark, args)
        return
    print(json.dumps(prepare(spark, args, chat_texts if args.command == "chat" else corpus_texts)))
    if args.verify:
        verify(spark, args.output).show(truncate=False)


if __name__ == "__main__":
    main()

"""Run configurations: nested JSON with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The sections of a configuration and their fields.
SCHEMA = (
    "run struct<name: string, log_interval: int, save_interval: int, seed: int, description: string>, "
    "dataset struct<dataset_folders: array<string>, dataset_weights: array<double>>, "
    "model struct<model: string, config: map<string, string>>, "
    "optimizer struct<max_lr: double, min_lr: double, warmup_steps: int, weight_decay: double, schedule: string, decay_frac: double, adam_b1: double, adam_b2: double, adam_eps: double>, "
    "tokenizer struct<vocab_path: string, bos_token: string, pad_token: string>, "
    "tokens struct<batch_size: int, grad_accum_steps: int, block_size: int, total_steps: long, total_tokens: long>, "
    "val_loss struct<interval: int, batches: int>"
)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each configuration file, with normalized weights and the fields' usual values where absent."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("c")).select("c.*")
    total = F.aggregate("dataset.dataset_weights", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("dataset", F.col("dataset").withField("dataset_weights", F.transform("dataset.dataset_weights", lambda w: w / total)))
    usual = {"log_interval": 10, "save_interval": 5000, "seed": 42, "description": ""}
    run = F.struct(F.col("run.name").alias("name"), *[F.coalesce(F.col(f"run.{name}"), F.lit(value)).alias(name) for name, value in usual.items()])
    return rows.withColumn("run", run)


def with_steps(configs: DataFrame) -> DataFrame:
    """With per_step and steps. A configuration with both limits or neither is an error."""
    tokens = F.col("tokens")
    per_step = tokens["batch_size"].cast("long") * tokens["grad_accum_steps"] * tokens["block_size"]
    both = F.when(tokens["total_steps"].isNull() == tokens["total_tokens"].isNull(), F.raise_error("give either total_steps or total_tokens"))
    steps = F.coalesce(both.cast("long"), tokens["total_steps"], F.floor(tokens["total_tokens"] / per_step).cast("long"))
    return configs.withColumn("per_step", per_step).withColumn("steps", steps)

"""Column expressions over arrays of numbers: probabilities, losses, norms, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """The sum of an array of doubles, in order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, f) -> Column:
    """f(value), with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of logits; logits that are NaN or infinite count as the least finite one."""
    endless = lambda z: F.isnan(z) | (F.abs(z) == F.lit(float("inf")))
    scaled = F.transform(logits, lambda z: z.cast("double") / F.lit(temperature))
    ends = lambda zs: F.struct(zs.alias("z"), F.array_min(F.filter(zs, lambda z: ~endless(z))).alias("low"), F.array_max(F.filter(zs, lambda z: ~endless(z))).alias("top"))
    weights = let(let(scaled, ends), lambda s: F.transform(s["z"], lambda z: F.exp(F.when(endless(z), s["low"]).otherwise(z) - s["top"])))
    return let(let(weights, lambda w: F.struct(w.alias("w"), total(w).alias("sum"))), lambda s: F.transform(s["w"], lambda w: w / s["sum"]))


def log_sum_exp(logits: Column) -> Column:
    """The logarithm of the sum of exponentials, computed around the maximum."""
    return let(F.array_max(logits).cast("double"), lambda top: top + F.log(total(F.transform(logits, lambda z: F.exp(z.cast("double") - top)))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """The loss of a target, counted from 0."""
    return log_sum_exp(logits) - F.element_at(logits, target + 1).cast("double")


def entropy(probabilities: Column) -> Column:
    """-sum p log(p + 1e-9)."""
    return -total(F.transform(probabilities, lambda p: p * F.log(p + F.lit(1e-9))))


def top_k(values: Column, k: int) -> Column:
    """The k largest values, falling."""
    return F.slice(F.sort_array(values, asc=False), 1, k)


def sampled(logits: Column, k: int, draw: Column, temperature: float = 1.0) -> Column:
    """The place, from 0, of a value drawn from the k largest: by their probabilities, renormalised, and a draw from [0, 1). Of equal values the first counts as larger; null for an empty array."""
    ranked = F.slice(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("low"), i.alias("place")))), 1, k)

    def of(top: Column) -> Column:
        weigh = lambda t: F.exp((top[0]["low"] - t["low"]) / F.lit(temperature))

        def drawn(goal: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("int").alias("place"))
            step = lambda s, t: let(s["upto"] + weigh(t), lambda upto: F.struct(upto.alias("upto"), F.coalesce(s["place"], F.when(upto > goal, t["place"])).alias("place")))
            return F.aggregate(top, start, step, lambda s: F.coalesce(s["place"], F.element_at(top, -1)["place"]))

        return let(draw * F.aggregate(top, F.lit(0.0), lambda s, t: s + weigh(t)), drawn)

    return F.when(F.size(logits) > 0, let(ranked, of))


def norm(values: Column) -> Column:
    """The Euclidean length."""
    return F.sqrt(total(F.transform(values, lambda x: x.cast("double") * x.cast("double"))))


def clip_ratio(length: Column, limit: float = 1.0) -> Column:
    """By how much a gradient of this length is scaled to stay within the limit."""
    return F.least(F.lit(1.0), F.lit(limit) / (length + F.lit(1e-12)))


def soft_cap(z: Column, cap: float) -> Column:
    """cap * tanh(z / cap)."""
    return F.lit(cap) * F.tanh(z / F.lit(cap))


def relu_squared(x: Column) -> Column:
    return F.pow(F.greatest(x, F.lit(0.0)), F.lit(2.0))


def silu(x: Column) -> Column:
    return x / (F.lit(1.0) + F.exp(-x))


def swiglu(x: Column, gate: Column) -> Column:
    """The gated form of silu."""
    return x * silu(gate)


def rms_norm(values: Column, eps: float = 1e-6) -> Column:
    """The array divided by its root mean square."""
    return let(F.sqrt(F.pow(norm(values), F.lit(2.0)) / F.size(values) + F.lit(eps)), lambda scale: F.transform(values, lambda x: x.cast("double") / scale))


def rotate_pairs(values: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary position encoding: each pair of neighbours turns by position / base^(2i/n)."""
    n = F.size(values)
    angle = lambda i: position / F.pow(F.lit(base), (i - F.pmod(i, F.lit(2))) / n)
    at = lambda k: F.element_at(values, k.cast("int")).cast("double")
    return F.transform(values, lambda x, i: F.when(F.pmod(i, F.lit(2)) == 0, x * F.cos(angle(i)) - at(i + 2) * F.sin(angle(i))).otherwise(at(i) * F.sin(angle(i)) + x * F.cos(angle(i))))


def learning_rate(step: Column, total_steps: int, warmup: int, max_lr: float, min_lr: float, decay_frac: float = 1.0, schedule: str = "cosine") -> Column:
    """The rate at a step: a linear rise from max_lr / warmup, a level stretch, and a cosine or linear fall over decay_frac of all steps (linear ends at min_lr too). An unknown schedule is an error."""
    if schedule not in ("cosine", "linear"):
        raise ValueError(f"unknown schedule {schedule!r}")
    decay = int(decay_frac * total_steps)
    stable = total_steps - warmup - decay
    fall = warmup + max(stable, 0)
    rise = F.lit(max_lr) * (F.lit(1.0 / max(warmup, 1)) + (F.lit(1.0) - F.lit(1.0 / max(warmup, 1))) * step / F.lit(float(max(warmup, 1))))
    share = F.least(F.lit(1.0), (step - F.lit(fall)) / F.lit(float(max(decay, 1))))
    if schedule == "cosine":
        falling = F.lit(min_lr) + F.lit(0.5 * (max_lr - min_lr)) * (F.lit(1.0) + F.cos(F.lit(math.pi) * share))
    else:
        falling = F.lit(max_lr) + F.lit(min_lr - max_lr) * share
    return F.when(step < warmup, rise).when(step < fall, F.lit(max_lr)).otherwise(falling if decay else F.lit(max_lr))


def tokens_per_step(batch: Column, accumulate: Column, block: Column) -> Column:
    return batch.cast("long") * accumulate.cast("long") * block.cast("long")


def total_steps(tokens: Column | None, per_step: Column, steps: Column | None = None) -> Column:
    """The given number of steps, or as many as the tokens fill; exactly one of the two must be given."""
    if (tokens is None) == (steps is None):
        raise ValueError("give either tokens or steps")
    return steps.cast("long") if tokens is None else F.floor(tokens / per_step).cast("long")

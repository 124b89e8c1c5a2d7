"""Multiple-choice evaluations: normal form, candidates, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import ranks


def normalized(df: DataFrame, question: str, answers: str, label: str) -> DataFrame:
    """(question, answers, label): rows without a label go; nulls within stay nulls."""
    key = F.col(label).cast("string")
    return df.where(key.isNotNull() & (key != "")).select(F.col(question).cast("string").alias("question"), F.transform(F.col(answers), lambda a: a.cast("string")).alias("answers"), key.cast("int").alias("label"))


def science_choices(df: DataFrame) -> DataFrame:
    """From question, choices (text, label) and answerKey: rows with an absent or empty key, without choices, or whose key isn't a choice go."""
    key, labels = F.col("answerKey"), F.col("choices.label")
    rows = df.where(key.isNotNull() & (key != "") & F.col("choices").isNotNull() & F.array_contains(labels, key))
    return rows.select("question", F.col("choices.text").alias("answers"), (F.array_position(labels, key) - 1).cast("int").alias("label"))


def fill_in_choices(df: DataFrame) -> DataFrame:
    """From sentence, option1, option2 and answer (1 or 2): the text before the first underscore, without white space at its end, is the question; each option with the rest an answer."""
    sentence, answer = F.col("sentence"), F.col("answer").cast("string")
    rows = df.where((F.instr(sentence, "_") > 0) & answer.isNotNull() & (answer != ""))
    place = F.instr(sentence, "_")
    rest = F.substring(sentence, place + 1, F.length(sentence))
    before = F.regexp_replace(F.substring(sentence, F.lit(1), place - 1), r"(?U)\s+$", "")
    return rows.select(before.alias("question"), F.array(F.concat("option1", rest), F.concat("option2", rest)).alias("answers"), (answer.cast("int") - 1).alias("label"))


def candidates(df: DataFrame, encode, bos_id: int, pad_id: int, block: int) -> DataFrame:
    """One row for each answer: ids of the delimiter, the question, and the answer with a space in front, cut to the last `block` ids and padded to the block; is_answer marks the answer's ids. encode: a column function from text to ids."""
    rows = df.select("example_id", "label", encode(F.col("question")).alias("q"), F.posexplode("answers").alias("candidate", "answer"))
    rows = rows.select("example_id", "label", "candidate", "q", encode(F.concat(F.lit(" "), F.col("answer"))).alias("a"))
    ids = F.concat(F.array(F.lit(bos_id)), F.col("q"), F.col("a"))
    rows = rows.select("example_id", "label", "candidate", F.size("a").alias("n_answer"), F.slice(ids, F.greatest(F.size(ids) - block + 1, F.lit(1)), block).alias("ids"))
    size = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(block) - size))
    mask = F.transform(F.sequence(F.lit(0), F.lit(block - 1)), lambda i: (i >= size - F.least(F.col("n_answer"), size)) & (i < size))
    return rows.select("example_id", "label", "candidate", padded.alias("ids"), mask.alias("is_answer"))


def scored(rows: DataFrame, scorer, encode, bos_id: int, pad_id: int, block: int) -> DataFrame:
    """(acc, acc_norm, num_total) of examples (example_id, question, answers, label) under a model. scorer: a function from candidates (example_id, label, candidate, ids, is_answer) to losses (example_id, candidate, loss, is_answer), a row for each token; whatever runs the model goes there, such as mapInArrow over the padded ids."""
    losses = scorer(candidates(rows, encode, bos_id, pad_id, block))
    return accuracy(candidate_scores(losses), rows)


def candidate_scores(losses: DataFrame) -> DataFrame:
    """(example_id, candidate, sum_loss, mean_loss) over the answer's tokens; without any the mean is 0."""
    own = F.when(F.col("is_answer"), F.col("loss").cast("double"))
    return losses.groupBy("example_id", "candidate").agg(F.coalesce(F.sum(own), F.lit(0.0)).alias("sum_loss"), F.count(own).alias("n")).select("example_id", "candidate", "sum_loss", (F.col("sum_loss") / F.greatest(F.col("n"), F.lit(1))).alias("mean_loss"))


def accuracy(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """(acc, acc_norm, num_total): how often the candidate of least sum, and of least mean, is the label; ties go to the first candidate. Null rates for no examples."""
    best = scores.groupBy("example_id").agg(F.min(F.struct("sum_loss", "candidate")).alias("s"), F.min(F.struct("mean_loss", "candidate")).alias("m"))
    rows = best.join(labels.select("example_id", "label"), "example_id")
    return rows.agg(F.avg((F.col("s.candidate") == F.col("label")).cast("double")).alias("acc"), F.avg((F.col("m.candidate") == F.col("label")).cast("double")).alias("acc_norm"), F.count(F.lit(1)).alias("num_total"))


def first_examples(df: DataFrame, n: int, order: str = "example_id") -> DataFrame:
    """The first n examples, or all if n isn't positive."""
    return df.orderBy(order).limit(n) if n > 0 else df


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With example_id: the row's place in the order, from 0."""
    return ranks.numbered(df, None, [F.col(c) for c in order], "example_id")

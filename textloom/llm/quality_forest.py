"""Quality rules: an isolation forest over rule statistics of each document.

Every document gets the statistics of the usual heuristic rules, as ratios. A forest of random splits
of these ratios, each tree grown on rows of its own, to which all labelled documents are dealt, gives
each document a mean path length: those that few splits isolate are anomalous. What the labels say is
used for the threshold on that score alone, over all labelled documents; without labelled documents there is no tree, and nothing goes by the score.

Nulls, ties and repeats: a null text has no words, so it fails the base rules; a null id
changes nothing; repeated rows each get the same verdict; an empty table gives no rows. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import scratch
from textloom.operators import ranks

from . import common

#: Trees, and the rows that each is grown on if there are no more than all trees together take. Of more rows each tree takes its share, and has the depth of so many, so that its size is bounded.
TREES, SUBSAMPLE = 200, 256
#: Bad labelled documents that one good one outweighs when the threshold is chosen.
GOOD_COST = 5.0
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines", "n_marks", "n_distinct")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more in the text, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = end = 0
    for k, window in enumerate(windows):
        if window in often:
            covered += k + 3 - max(k, end)
            end = k + 3
    return covered


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text."""
    words = text.split()
    solid = text.translate(None, common.SPACES)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "surrogatepass"))
    return (
        len(words),
        chars,
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicate_lines(text),
        repeated_words(words),
        len(text) - len(text.translate(None, UPPER)),
        text.count(b"\n") + 1,
        text.count(b"!"),
        len(set(words)),
    )


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(x) for x in common.bytes_of(batch.column(1))]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], ["doc_id", *COUNTS])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_statistics_of, STATS_SCHEMA)


def ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The ratios that the rules look at: characters a word (of 6, at most 12), symbols and exclamation marks a word (at most 1), repeated lines, words in repeated windows, and capitals."""
    n = np.maximum(counts["n_words"], 1)
    found = (
        np.minimum(counts["word_chars"] / n, 12.0) / 6.0,
        np.minimum(counts["n_symbols"] / n, 1.0),
        counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1),
        counts["n_repeat_words"] / n,
        np.minimum(counts["n_upper"] / np.maximum(counts["word_chars"], 1), 1.0),
        np.minimum(counts["n_marks"] / n, 1.0),
    )
    return np.stack([np.asarray(r, float) for r in found], 1)


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Random splits, of a ratio drawn in proportion to its range among a node's rows, so that ratios in which none of them stands out are seldom split; rows that end near the root are anomalous."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        rows = rows[np.lexsort(rows.T)]  # the same forest whatever order the sample came in
        self.trees, self.norm = [], _average_path(min(subsample, max(len(rows), 2))) or 1.0
        deepest = math.ceil(math.log2(max(subsample, 2)))
        order, size = rng.permutation(len(rows)), min(subsample, len(rows))
        for k in range(trees if len(rows) else 0):  # rows of its own for each tree, as far as there are any
            own = order[k * size : k * size + size] if (k + 1) * size <= len(rows) else rng.choice(len(rows), size, replace=False)
            self.trees.append(self.grow(rows[own], deepest, rng))

    @classmethod
    def of_trees(cls, trees: list[tuple[np.ndarray, ...]], rows: float) -> IsolationForest:
        """Trees that were grown elsewhere, each on so many rows on the average."""
        found = cls.__new__(cls)
        found.trees, found.norm = trees, _average_path(rows)
        return found

    @staticmethod
    def grow(rows: np.ndarray, deepest: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, path = [], [], [], [], []
        todo = [(rows, 0, -1, False)]
        while todo:
            own, depth, parent, is_right = todo.pop()
            at = len(feature)
            if parent >= 0:
                (right if is_right else left)[parent] = at
            span = own.max(0) - own.min(0) if len(own) else np.zeros(rows.shape[1])
            varied = len(own) > 1 and depth < deepest and span.any()
            feature.append(-1), cut.append(0.0), left.append(at), right.append(at), path.append(depth + _average_path(len(own)))
            if varied:
                feature[at] = f = int(rng.choice(len(span), p=span / span.sum()))
                cut[at] = c = rng.uniform(own[:, f].min(), own[:, f].max())
                todo += [(own[own[:, f] <= c], depth + 1, at, False), (own[own[:, f] > c], depth + 1, at, True)]
        return tuple(np.array(x) for x in (feature, cut, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / normal path): towards 1 for anomalies, 0.5 for a forest without trees."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), int)
            for _ in range(len(feature)):
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(rows[np.arange(len(rows)), f] <= cut[at], left[at], right[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.norm)


def calibrated(scored: DataFrame, cost: float = GOOD_COST) -> float:
    """The score above which a document goes, from (score, good): it makes the bad rows kept plus `cost` times the good rows rejected least, the highest of equals. Without good rows, nothing goes. A row for each score, in ranges: the driver gets the best cut."""
    sums = scored.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    gain = F.round(1000 * (F.col("bad") - F.lit(cost) * F.col("good"))).cast("long")  # sums of whole numbers don't depend on their order
    placed = scratch.saved(ranks.with_sum(sums.withColumn("gain", gain), None, [F.col("score")], "gain", "before"), "scores")
    total = placed.agg(F.sum("good")).first()[0]
    if not total:
        return 1.0
    # a cut above a score keeps it and all below: bad ones that are kept add to the loss, good ones take from it
    loss = F.col("before") + F.col("gain")
    low = placed.select("score", loss.alias("loss")).orderBy("loss", F.desc("score")).first()["score"]
    above = placed.where(F.col("score") > low).agg(F.min("score")).first()[0]
    return float(low if above is None else (low + above) / 2)


def base_failed(n_words, n_repeat_words):
    """Fewer than 50 words, or more than half of them in repeated windows."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _numpy(rows: list) -> dict[str, np.ndarray]:
    return {c: np.array([r[c] for r in rows], np.int64) for c in COUNTS}


class Judge:
    """The forest over the ratios, and the threshold on its score."""

    def __init__(self, forest: IsolationForest, threshold: float):
        self.forest, self.threshold = forest, threshold

    def score(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        return self.forest.score(ratios(counts))


def forest_of(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> IsolationForest:
    """A forest on all rows of counts. If they are more than trees * subsample, each goes to one tree by its hash and a task grows a tree; the driver gets the trees, whose size is bounded."""
    n = stats.count()
    if n <= trees * subsample:
        return IsolationForest(ratios(_numpy(stats.select(*COUNTS).collect())), trees, subsample, seed)

    def grown(table: pa.Table) -> pa.Table:
        rows, tree = ratios({c: table.column(c).to_numpy() for c in COUNTS}), table.column("tree")[0].as_py()
        rows = rows[np.lexsort(rows.T)]  # the same tree whatever order the rows came in
        found = IsolationForest.grow(rows, math.ceil(math.log2(subsample)), np.random.default_rng([seed, tree]))
        return pa.table({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([pickle.dumps(found)], pa.binary())})

    dealt = stats.select(F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(trees)).cast("int").alias("tree"), *COUNTS)
    found = dealt.groupBy("tree").applyInArrow(grown, "tree int, nodes binary").collect()
    return IsolationForest.of_trees([pickle.loads(r["nodes"]) for r in sorted(found, key=lambda r: r["tree"])], n / trees)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Judge:
    """Grow the forest on all labelled documents, whatever their labels, and take the threshold from all of those that pass the base rules. Nothing is learned from other rows; without labelled ones, all that pass the base rules are kept."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("label"))
    labelled = common.saved(stats.join(known, "doc_id").distinct(), "labelled")
    model = Judge(forest_of(labelled), 1.0)
    usual = judge(labelled.select(*stats.columns, (F.col("label") > 0).alias("good")), model).where(~F.col("base_failed"))
    scored = usual.select(F.col("anomaly").alias("score"), "good")
    return Judge(model.forest, calibrated(scored))


def judge(stats: DataFrame, model: Judge) -> DataFrame:
    """The statistics with `anomaly` (0 to 1), `base_failed` and `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}
            score, failed = model.score(counts), base_failed(counts["n_words"], counts["n_repeat_words"])
            more = [pa.array(score), pa.array(failed), pa.array(~failed & (score <= model.threshold))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "anomaly", "base_failed", "kept"])

    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(run, own + ", anomaly double, base_failed boolean, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, anomaly score and verdict of every document. The texts are read once; all else works on the counts, written to the shared folder."""
    stats = common.saved(document_statistics(docs, id_col, text_col), "rule-statistics")
    return judge(stats, fit(stats, labels))

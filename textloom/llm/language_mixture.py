"""Language ID: expectation-maximisation over the languages that a document mixes.

Each language has a table of byte trigram and tetragram probabilities. In a document, every word
has a likelihood under each language, from its n-grams; expectation-maximisation finds the
proportions of languages that explain the words best. Languages are then dropped one by one as
long as the penalised likelihood of the document (BIC) gains. The predicted language is the one
with the largest proportion among those that stay.

Nulls, ties and repeats: a null text, or one without a letter, is `und` with score 0, and so is
every text if no row has a language to learn from; ties go to the language that sorts first; a
null id is no obstacle; repeated rows each get the same result; an empty table gives no rows.
Columns other than id, text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents that one language's tables are learned from, at most about, and the tasks that count them.
DOCS_PER_LANGUAGE, FIT_TASKS = 5000, 16
#: Buckets of each n-gram table; added counts; steps of expectation-maximisation; bytes scored at once.
BUCKETS, SMOOTHING, STEPS, SLICE = 1 << 16, 0.05, 8, 1 << 19
#: Pseudo-words that the learned shares of languages count for in a document's proportions.
PRIOR_WORDS = 0.5
#: Below this share of its best likelihood, a word's likelihood under a language isn't trusted.
LEAST = 1e-4
#: Languages at most: each has half a megabyte of tables on the driver and in every worker, so a column of other things is refused.
LANGUAGES = 1000
UNDEFINED = "und"
LETTER = regex.compile(r"\p{L}")

#: Lower case for A-Z, a space for every other ASCII byte that isn't a letter or an apostrophe.
FOLD = np.array([32 if x < 128 and not chr(x).isalpha() and x != 39 else x + 32 if 65 <= x <= 90 else x for x in range(256)], np.uint8)


def _buckets(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte but the padding, the buckets of the trigram around it and of the tetragram that begins before it. text: folded, with a space in front and two behind."""
    a, b, c, d = (text[k : len(text) - 3 + k].astype(np.uint32) for k in range(4))
    three = (a << np.uint32(16)) | (b << np.uint32(8)) | c
    four = (three << np.uint32(8)) ^ (d * np.uint32(0x9E3779B1)) ^ (a * np.uint32(0x85EBCA6B))
    return (three * np.uint32(2654435761)) >> np.uint32(16), (four * np.uint32(2246822519)) >> np.uint32(16)


def _padded(text: bytes) -> np.ndarray:
    return np.concatenate([[np.uint8(32)], FOLD[np.frombuffer(text, np.uint8)], [np.uint8(32)] * 2]).astype(np.uint8)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), common.bytes_of(batch.column(1))):
            table = found.setdefault(lang, np.zeros((2, BUCKETS), np.float64))
            for at in range(0, len(text), SLICE):
                padded = _padded(text[at : at + SLICE])
                inside = padded[1:-2] != 32
                for k, codes in enumerate(_buckets(padded)):
                    table[k] += np.bincount(codes[inside], minlength=BUCKETS)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([x.astype(np.float32).tobytes() for x in found.values()], pa.binary())], ["lang", "counts"])


class Model:
    """Languages, sorted; for each bucket of the two tables the log probability under every language; the share of each language among the rows learned from."""

    def __init__(self, langs: list[str], tables: np.ndarray, prior: np.ndarray):
        self.langs, self.tables, self.prior = langs, tables, prior

    def word_likelihoods(self, text: bytes) -> np.ndarray:
        """A row for each word: its likelihood under each language over that under the best one, and LEAST at least."""
        rows = []
        for part in _parts(text):
            padded = _padded(part)
            solid = padded != 32
            inside = solid[1:-2]
            starts = np.flatnonzero(inside & ~solid[:-3])
            if not len(starts):
                continue
            three, four = _buckets(padded)
            logs = self.tables[0][three]
            logs += self.tables[1][four]
            logs[~inside] = 0
            rows.append(np.add.reduceat(logs, starts, axis=0))
        if not rows:
            return np.zeros((0, len(self.langs)), np.float32)
        found = np.concatenate(rows) if len(rows) > 1 else rows[0]
        found -= found.max(1, keepdims=True)
        return np.maximum(np.exp(found), np.float32(LEAST))


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in slices that end at a space, where there is one."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end)) + 1
            end = end if end > at else at + SLICE
        yield text[at:end]
        at = end


def mixtures(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the languages in each document and which of them the penalised likelihood selects.

    words: likelihood rows of all documents' words in order; starts, sizes: where each document's
    rows begin, and how many there are (1 at least).
    """
    n, k = len(starts), words.shape[1]
    doc = np.repeat(np.arange(n), sizes)
    chosen = np.ones((n, k), bool)

    def expectation(share: np.ndarray, steps: int) -> np.ndarray:
        for _ in range(steps):
            post = words * share[doc]
            post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(post, starts, axis=0) + PRIOR_WORDS * prior * chosen
            share /= share.sum(1, keepdims=True)
        return share

    def likelihood(share: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.log(np.maximum((words * share[doc]).sum(1), 1e-30)), starts)

    share = expectation(np.repeat(prior[None].astype(np.float32), n, 0), STEPS)
    penalty = 0.5 * np.log(np.maximum(sizes, 2)) + 2.0
    for _ in range(k - 1):
        rest = np.where(chosen, share, np.inf)
        drop = rest.argmin(1)
        fewer = share.copy()
        fewer[np.arange(n), drop] = 0
        fewer /= np.maximum(fewer.sum(1, keepdims=True), 1e-30)
        worth = (chosen.sum(1) > 1) & (likelihood(share) - likelihood(fewer) < penalty)
        if not worth.any():
            break
        chosen[np.flatnonzero(worth), drop[worth]] = False
        share = np.where(worth[:, None], fewer, share)
    return expectation(share, 1), chosen


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learn the tables from about per_language rows of each language; rows whose id's crc32 modulo 5 is 0, and rows without language or text, aren't learned from."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")).where(F.col("lang").isNotNull() & ~common.held_out(F.col("doc_id"), 5))
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if len(seen) > LANGUAGES:
        raise ValueError(f"{len(seen)} languages: more than {LANGUAGES}")
    if not seen:
        return Model([], np.zeros((2, BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    limits = F.create_map(*[F.lit(x) for lang, n in seen.items() for x in (lang, common.hash_limit(per_language, n))])
    # distinct rows, so that one repeated without end is learned from once
    sample = rows.where(F.col("text").isNotNull() & (F.xxhash64("doc_id", "text", F.lit(31)) <= limits[F.col("lang")].cast("long"))).distinct().select("lang", "text")
    langs = sorted(seen)
    counts = np.zeros((len(langs), 2, BUCKETS), np.float64)
    for lang, found in sample.repartition(FIT_TASKS).mapInArrow(_count, "lang string, counts binary").toLocalIterator():
        counts[langs.index(lang)] += np.frombuffer(found, np.float32).reshape(2, BUCKETS)
    counts += SMOOTHING
    logs = np.log(counts / counts.sum(2, keepdims=True)).astype(np.float32)
    prior = np.array([seen[x] for x in langs], float)
    return Model(langs, np.ascontiguousarray(logs.transpose(1, 2, 0)), (prior / prior.sum()).astype(np.float32))


def _predict(model: Model, ids: list, texts: list[str | None]) -> pa.RecordBatch:
    langs, scores, kinds = [UNDEFINED] * len(ids), [0.0] * len(ids), [0] * len(ids)
    at, words = [], []
    for k, text in enumerate(texts):
        if model.langs and text and LETTER.search(text):
            rows = model.word_likelihoods(text.encode())
            if not len(rows):
                rows = np.ones((1, len(model.langs)), np.float32)
            at.append(k), words.append(rows)
    if at:
        sizes = np.array([len(x) for x in words])
        share, chosen = mixtures(np.concatenate(words), np.cumsum(sizes) - sizes, sizes, model.prior)
        best = np.where(chosen, share, -1).argmax(1)
        for k, b, s, c in zip(at, best, share, chosen):
            langs[k], scores[k], kinds[k] = model.langs[b], min(1.0, float(s[b])), int(c.sum())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(scores, pa.float64()), pa.array(kinds, pa.int32())], ["doc_id", "lang_pred", "score", "n_langs"])


def _predicted(model: Model, ids: list, texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    """Predictions for a batch, in runs of bounded text; at least one, even if empty."""
    size = first = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size > SLICE:
            yield _predict(model, ids[first : k + 1], texts[first : k + 1])
            size, first = 0, k + 1
    yield _predict(model, ids[first:], texts[first:])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its main language, that language's share, and how many languages are selected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _predicted(shared.value, batch.column(0).to_pylist(), batch.column(1).to_pylist())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is predicted, however many others it is mixed with; with a model of no languages, those with a letter."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if shared.value.langs:
                found = pa.Table.from_batches(_predicted(shared.value, [0] * batch.num_rows, texts))
                keep = [x != UNDEFINED for x in found["lang_pred"].to_pylist()]
            else:
                keep = [bool(x and LETTER.search(x)) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out and predict for all of them."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)

"""Byte-pair vocabularies: training on counted chunks, encoding, decoding."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom import scratch
from textloom.functions import text as T
from textloom.operators import merges
from textloom.session import bounded
from textloom.shipping import ship

#: Chunks whose ids a task remembers, at most about; chunks or ids that it handles at once. One text may have more.
MEMO, TOGETHER = 100_000, 100_000


@dataclass
class Vocabulary:
    """Tokens by id, merges by the id they make, and how texts are cut. Special tokens have ids of their own."""

    mode: str
    tokens: list[str | bytes]
    merges: dict[int, tuple[int, int]]
    specials: list[str] = field(default_factory=list)

    def __post_init__(self):
        self.ranks = {pair: made for made, pair in self.merges.items()}
        self.index = {t: i for i, t in enumerate(self.tokens)}

    def typed(self, token: str) -> str | bytes:
        return token.encode() if self.mode == T.BYTES else token

    def id_of(self, token: str) -> int:
        return self.index[self.typed(token)]

    def encode_chunk(self, chunk: str) -> list[int]:
        """Merge the neighbours whose merge was learned first, the leftmost of equals, until none is left."""
        if chunk in self.specials:
            return [self.id_of(chunk)]
        if self.mode == T.BYTES:
            ids = [self.index[bytes([b])] for b in chunk.encode()]
        else:
            missing = [c for c in chunk if c not in self.index]
            if missing:
                raise ValueError(f"the vocabulary has no {missing[0]!r}")
            ids = [self.index[c] for c in chunk]
        return self._merged(ids)

    def _merged(self, ids: list[int]) -> list[int]:
        """The ids after all merges: a queue of the neighbours that can be merged, over a linked list of places."""
        ranks, n = self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(made, k) for k, pair in enumerate(zip(ids, ids[1:])) if (made := ranks.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            made, k = heapq.heappop(queue)
            right = after[k]
            if ids[k] < 0 or right >= n or ranks.get((ids[k], ids[right])) != made:
                continue  # one of the two has been merged since
            ids[k], ids[right] = made, -1
            after[k] = right = after[right]
            if right < n:
                before[right] = k
                if (next_made := ranks.get((made, ids[right]))) is not None:
                    heapq.heappush(queue, (next_made, k))
            if (left := before[k]) >= 0 and (next_made := ranks.get((ids[left], made))) is not None:
                heapq.heappush(queue, (next_made, left))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' text; bytes that aren't UTF-8 are replaced."""
        tokens = [self.tokens[i] for i in ids]
        return b"".join(tokens).decode("utf-8", "replace") if self.mode == T.BYTES else "".join(tokens)

    def with_specials(self, more: list[str]) -> Vocabulary:
        """A vocabulary with those special tokens that this one lacks, at the next ids."""
        new = [s for s in dict.fromkeys(more) if self.typed(s) not in self.index]
        return Vocabulary(self.mode, [*self.tokens, *map(self.typed, new)], dict(self.merges), [*self.specials, *new])


def train(counts: DataFrame, vocab_size: int, specials: list[str], mode: str = T.BYTES) -> Vocabulary:
    """Greedy merges over counted chunks (chunk, cnt) until the vocabulary, special tokens included, has its size or no pair is left.

    The chunks stay in tables (see merges): the driver gets the alphabet, which is bounded by Unicode, and the merges.
    """
    rows = counts.where(~F.col("chunk").isin(*specials) if specials else F.lit(True)).where(F.col("chunk").isNotNull() & (F.col("cnt") > 0)).select("chunk", F.col("cnt").cast("long").alias("weight"))
    if mode == T.BYTES:
        tokens: list = [bytes([b]) for b in range(256)]
        wide = None
    else:
        tokens = sorted(r["ch"] for r in rows.select(F.explode(T.characters(F.col("chunk"))).alias("ch")).distinct().collect())
        wide = {ord(c): i for i, c in enumerate(tokens)}
    if vocab_size < len(tokens) + len(specials):
        raise ValueError(f"a vocabulary of {vocab_size} can't hold {len(tokens)} base and {len(specials)} special tokens")
    ship(counts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            found = [np.frombuffer(c.encode(), np.uint8).astype(np.int32).tobytes() if wide is None else np.array([wide[ord(x)] for x in c], np.int32).tobytes() for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["run", "weight"])

    # a chunk of one id has no pair
    runs = scratch.saved(rows.mapInArrow(run, "run binary, weight long").where(F.length("run") > 4), "runs")
    found = merges.learned(runs, len(tokens), vocab_size - len(tokens) - len(specials))
    scratch.drop(runs)
    for left, right in found.values():
        tokens.append(tokens[left] + tokens[right])
    return Vocabulary(mode, tokens, found).with_specials(specials)


def _slices(batches: Iterator[pa.RecordBatch], at: int, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows in slices whose lists in a column have about `most` values together, at least one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
            yield batch.slice(low, high - low)
            low = high


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids", bos: str | None = None) -> DataFrame:
    """The frame with a column of ids; null for a null text. With bos, its id comes first.

    Texts are cut into chunks in the JVM; a task encodes a distinct chunk once, as long as it remembers it.
    """
    ship(df.sparkSession)
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    first = [vocabulary.id_of(bos)] if bos else []
    rows = df.withColumn(out, T.pretokens(F.col(text_col), vocabulary.mode, tuple(vocabulary.specials)))
    schema = rows.schema
    at = rows.columns.index(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, {}
        for batch in _slices(batches, at):
            chunks = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False)
            coded = chunks.flatten().dictionary_encode()
            if len(memo) > MEMO:
                memo.clear()
            rows = []
            for chunk in coded.dictionary.to_pylist():  # each distinct chunk once
                found = memo.get(chunk)
                if found is None:
                    found = memo[chunk] = own.encode_chunk(chunk)
                rows.append(found)
            which = coded.indices.to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            if first:
                which, ends = np.insert(which, ends[:-1], len(rows)), ends + np.arange(len(ends))
                rows.append(first)
            starts = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
            every = pa.LargeListArray.from_arrays(pa.array(starts), pa.array([i for r in rows for i in r], pa.int32()))
            flat = every.take(pa.array(which)).flatten()
            places = np.concatenate([[0], np.cumsum(np.diff(starts)[which])])[ends]
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), flat, mask=chunks.is_null())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = [f"`{f.name}` {'array<int>' if k == at else f.dataType.simpleString()}" for k, f in enumerate(schema)]
    return rows.mapInArrow(run, ", ".join(fields))


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The frame with the text of a column of ids; null for null."""
    ship(df.sparkSession)
    bounded(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array([t.encode() if isinstance(t, str) else t for t in shared.value.tokens], pa.large_binary())
        for batch in _slices(batches, at):
            ids = batch.column(at)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            found = tokens.take(ids.flatten())  # their bytes lie one after the other, so a row's text is a slice
            places, data = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1], (found.buffers()[2] or b"")
            data = memoryview(data)
            texts = [None if null else str(data[places[a] : places[b]], "utf-8", "replace") for null, a, b in zip(ids.is_null().to_pylist(), ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string")

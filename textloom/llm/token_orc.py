"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents go out in ascending order of their ids, one sorted file for each range of ids. A file's
stripes are read in parallel, its row indexes and Bloom filters let a reader of few documents skip
the rest, and each row knows how many ids its file holds before it, so a document's place in the
whole sequence needs only the files' totals.

Texts are encoded by the tokenizers library. Since no token spans the border before a white-space
character that follows another character, a text is cut there and a distinct piece is encoded
once by a worker that remembers it; texts in which a border is in doubt go to the library whole.

Nulls, ties and repeats: a null or empty text is the end id alone; rows with a null id come first;
rows that share an id come in the order of the table; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pieces that a Python worker remembers, besides those of one batch.
MEMO = 300_000
#: Batches whose texts are encoded together.
GROUP = 2
#: New pieces that are encoded as one text, and texts encoded at once: what the library makes of them takes far more memory than their ids.
RUN, RUNS = 500, 32
#: Stops that may follow a word (ASCII punctuation but the apostrophe, which may begin a contraction), how many of them at most are cut off it, and the last letter of a word that they are cut from: what is a letter up to there is the same in all versions of Unicode.
STOPS, TAIL, LETTERS = string.punctuation.replace("'", ""), 3, "\u052f"
#: A word that stops are cut from.
WORD = rf"\A[{''.join(map(re.escape, filter(str.isalpha, map(chr, range(ord(LETTERS) + 1)))))}]+\z"
#: Bytes of a stripe, rows of an index entry, false positives of the Bloom filters, and the codec.
STRIPE, STRIDE, FALSE_POSITIVES, CODEC = 16 << 20, 1000, 0.01, "zstd"
#: Fixed value: white space as Unicode has it. A border before a space is in doubt after any of it, and at the text's end.
SPACES = r"\t-\r\x1c- \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SCHEMA = "doc_id long, shard int, file_start long, n_tokens long, ids array<int>"


def taken(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some rows of ids, one after the other, and where each begins and the last ends."""
    sizes = np.diff(offsets)[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.arange(ends[-1]) + np.repeat(offsets[which] - ends[:-1], sizes)], ends


class Encoder:
    """The library's tokenizer with the ids of recent pieces, kept in arrays: what is looked up, learned and put together is a whole batch at once, not a piece."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.doubtful = "|".join([f"[{SPACES}] ", r" \z", *specials])
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes[i] = len(token)  # each character stands for a byte
        self.tails: dict[int, np.ndarray] = {}
        self.memo = memo
        self.known, self.ids, self.offsets = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.hits = np.zeros(0, np.int64)

    def _flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.fromiter(accumulate(map(len, ids), initial=0), np.int64, len(ids) + 1)
        return np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]), ends

    def _runs(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that don't end with white space, each with a space before it: they are encoded in runs, and the bytes that tokens stand for tell where each piece ends."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        borders = pa.array([*range(0, len(pieces), RUN), len(pieces)], pa.int32())
        runs, rows = [" " + x for x in pc.binary_join(pa.ListArray.from_arrays(borders, pieces), " ").to_pylist()], []
        for k in range(0, len(runs), RUNS):
            rows.append(self._flat(runs[k : k + RUNS])[0])
        ids = np.concatenate(rows)
        ends, stops = np.cumsum(self.bytes[ids]), np.cumsum(pc.binary_length(pieces).to_numpy().astype(np.int64) + 1)
        last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
        if not np.array_equal(ends[last], stops):  # a token that spans the border of two pieces: never so with a byte-level splitter
            return self._flat([" " + p for p in pieces.to_pylist()])
        return ids, np.concatenate([[0], last + 1])

    def _remembered(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of what is remembered, distinct pieces among it, each with a space before it; and which of them each piece is. Pieces that few batches hold are forgotten first."""
        if len(self.known) > self.memo:
            kept = np.sort(np.argsort(self.hits, kind="stable")[-(self.memo // 2) :])
            self.known, self.hits = self.known.take(pa.array(kept)), self.hits[kept] >> 1
            self.ids, self.offsets = taken(self.ids, self.offsets, kept)
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null()
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        unknown = pieces.filter(new)
        if len(unknown):
            new = new.to_numpy(zero_copy_only=False)
            spaced = pc.match_substring_regex(unknown, rf"[{SPACES}]\z")
            at[np.flatnonzero(new)[np.argsort(spaced.to_numpy(zero_copy_only=False), kind="stable")]] = len(self.known) + np.arange(len(unknown))
            joined, alone = unknown.filter(pc.invert(spaced)), unknown.filter(spaced)
            for ids, ends in (self._runs(joined), self._flat([" " + p for p in alone.to_pylist()])):
                self.offsets = np.concatenate([self.offsets, len(self.ids) + ends[1:]])
                self.ids = np.concatenate([self.ids, ids])
            self.known = pa.concat_arrays([self.known, joined, alone])
            self.hits = np.concatenate([self.hits, np.zeros(len(unknown), np.int64)])
        self.hits[at] += 2
        return self.ids, self.offsets, at

    def _tails(self, pieces: pa.Array, sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of the distinct stops that some pieces end with, so many on each, and which of them each piece has."""
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1 :][: len(pieces)]
        data, code = np.frombuffer(pieces.buffers()[2], np.uint8), np.zeros(len(pieces), np.int64)
        for k in range(TAIL):
            held = sizes > k
            code[held] |= data[ends[held] - 1 - k].astype(np.int64) << (8 * k)
        distinct, which = np.unique(code, return_inverse=True)
        for x in distinct.tolist():
            if x not in self.tails:
                self.tails[x] = self._flat([x.to_bytes(TAIL, "big").lstrip(b"\0").decode()])[0]
        return [self.tails[x] for x in distinct.tolist()], which

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, each with a space before it, and their borders. A word with stops after it is remembered as the word alone: the splitter always cuts between letters and stops."""
        words = pc.ascii_rtrim(pieces, characters=STOPS)
        sizes = (pc.binary_length(pieces).to_numpy() - pc.binary_length(words).to_numpy()).astype(np.int64)
        cut = (sizes > 0) & (sizes <= TAIL)
        cut[cut] = pc.match_substring_regex(words.filter(pa.array(cut)), WORD).to_numpy(zero_copy_only=False)
        coded = pc.if_else(pa.array(cut), words, pieces).dictionary_encode()
        ids, offsets, at = self._remembered(coded.dictionary)
        tails, tail_of = self._tails(pieces.filter(pa.array(cut)), sizes[cut]) if cut.any() else ([], np.zeros(0, np.int64))
        rows = np.empty(len(pieces) + len(tail_of), np.int64)
        place = np.arange(len(pieces)) + np.cumsum(cut) - cut
        rows[place] = at[coded.indices.to_numpy()]
        rows[place[cut] + 1] = len(offsets) - 1 + tail_of
        more = np.cumsum([len(x) for x in tails], dtype=np.int64)
        flat, ends = taken(np.concatenate([ids, *tails]), np.concatenate([offsets, offsets[-1] + more]), rows)
        return flat, ends[np.append(place, len(rows))]

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct pieces of some texts and of their beginnings, with their borders; which of them each text's pieces are, one after the other; and where each text begins among these."""
        doubt = pc.match_substring_regex(texts, self.doubtful)
        parts = pc.split_pattern(pc.if_else(doubt, "", texts), " ")
        starts = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        words, begins = parts.flatten(), np.zeros(starts[-1], bool)
        begins[starts[:-1]] = True
        coded = words.filter(pa.array(~begins)).dictionary_encode()
        flat, ends = self._distinct(coded.dictionary)
        which = np.empty(len(words), np.int64)
        which[~begins] = coded.indices.to_numpy()
        which[begins] = np.arange(len(ends) - 1, len(ends) - 1 + len(texts))
        first, borders = self._flat(pc.if_else(doubt, texts, words.take(pa.array(starts[:-1]))).to_pylist())
        return np.concatenate([flat, first]), np.concatenate([ends, ends[-1] + borders[1:]]), which, starts

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """Numbers of ids of each text; null as empty."""
        if not len(texts):
            return np.zeros(0, np.int64)
        _, ends, which, starts = self._pieces(pc.fill_null(texts, ""))
        return np.add.reduceat(np.diff(ends)[which], starts[:-1])

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other and each followed by `end` (ids as little-endian 32-bit integers), and where each text's begin and the last ones end; null as empty."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        flat, ends, which, starts = self._pieces(pc.fill_null(texts, ""))
        last = np.frombuffer(end, np.int32)
        which = np.insert(which, starts[1:], len(ends) - 1)  # the last of the rows to take
        ids, borders = taken(np.concatenate([flat, last]), np.append(ends, ends[-1] + len(last)), which)
        return ids, borders[starts + np.arange(len(starts))]


#: One encoder for each vocabulary and size of memory in a Python worker, which runs many tasks.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, memo: int = MEMO) -> Encoder:
    common.remembering("tokens", _ENCODERS.clear)
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = Encoder(path, memo)
    return _ENCODERS[path, memo]


def _encode(path: str, end_id: int):
    end = np.array([end_id], np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = encoder(path), 0
        for batch in common.grouped(batches, GROUP):
            with common.uncollected():
                flat, ends = own.encode(batch.column(1), end)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(total + ends[:-1]), pa.array(np.diff(ends)), ids], ["doc_id", "shard", "file_start", "n_tokens", "ids"])
            total += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them in ascending order of their ids; path must not exist."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # numbered rows, so that one id's, or those without an id, can be dealt to several tasks
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange("doc_id", "_row").sortWithinPartitions("doc_id", "_row").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    options = {
        "orc.compress": CODEC,
        "orc.stripe.size": str(STRIPE),
        "orc.create.index": "true",
        "orc.row.index.stride": str(STRIDE),
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": str(FALSE_POSITIVES),
    }
    ranged.mapInArrow(_encode(tokenizer, end_id), SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids. A filter on doc_id reaches the files' statistics."""
    files = spark.read.schema(SCHEMA).orc(path)
    starts, total = [], 0
    for shard, size in files.groupBy("shard").agg(F.sum("n_tokens")).orderBy("shard").toLocalIterator():  # one row for each file
        starts.append((shard, total))
        total += size
    starts = spark.createDataFrame(starts, "shard int, before long")
    return files.join(F.broadcast(starts), "shard").select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        values, ends = ids.values.to_numpy().astype("<i4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned crc32 of each document's ids."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""From token streams to training samples: spans, chunks, shifts, masks, packs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom import scratch
from textloom.operators import bins
from textloom.shipping import ship

#: Code points that a task lays out at once; one text may have more.
POINTS = 1 << 20


def _places(tokens: Column, bos: int) -> Column:
    """Where the delimiters are."""
    return F.array_remove(F.transform(tokens, lambda t, i: F.when(t == bos, i).otherwise(F.lit(-1))), -1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used."""
    return F.transform(F.array(value), use).getItem(0)


def spans(tokens: Column, bos: int) -> Column:
    """array<struct<start, end>>: from each delimiter to the next or to the end (exclusive); what stands before the first is no document."""

    def between(places: Column) -> Column:
        ends = F.concat(F.slice(places, 2, F.size(places)), F.array(F.size(tokens)))
        return F.when(F.size(places) > 0, F.arrays_zip(places.alias("start"), ends.alias("end")))

    return _once(_places(tokens, bos), between)


def without_prefix(tokens: Column, bos: int) -> Column:
    """The tokens from the first delimiter on; none without one."""
    place = F.array_position(tokens, bos).cast("int")
    return F.when(place > 0, F.slice(tokens, F.greatest(place, F.lit(1)), F.size(tokens))).otherwise(F.slice(tokens, 1, 0))


def chunk_starts(start: Column, end: Column, block: int) -> Column:
    """array<struct<start, len>>: a span cut into pieces of `block` tokens, the last shorter."""
    return F.transform(F.sequence(start, F.greatest(end - 1, start), F.lit(block)), lambda s: F.struct(s.alias("start"), F.least(F.lit(block), end - s).alias("len")))


def padded(tokens: Column, block: int, pad: int) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(block) - F.size(tokens), F.lit(0))))


def shifted(tokens: Column, block: int, pad: int) -> Column:
    """Each place holds the next token; the last real one and all after it hold the padding."""
    return padded(F.slice(tokens, 2, F.size(tokens)), block, pad)


def document_ids(x: Column, bos: int) -> Column:
    """For each place the number of delimiters up to it, less one, and 0 at least; padding keeps the last number. Runs between delimiters are repeated, so it takes time in proportion to the places."""

    def numbered(places: Column) -> Column:
        cuts = F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0)))
        runs = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("begin"), F.concat(cuts, F.array(F.size(x))).alias("end"))
        return F.flatten(F.transform(runs, lambda s, k: F.array_repeat(k, s["end"] - s["begin"])))

    # without a delimiter, no token need be looked at by itself
    return F.when(~F.array_contains(x, bos), F.array_repeat(F.lit(0), F.size(x))).when(x.isNotNull(), _once(_places(x, bos), numbered))


def loss_mask(x: Column, y: Column, pad: int) -> Column:
    return F.zip_with(x, y, lambda a, b: (a != pad) & (b != pad))


def sample_mask(tokens: Column, x: Column, y: Column, block: int, pad: int) -> Column:
    """loss_mask of the padded and shifted tokens: all but the last, unless the padding occurs among them."""
    real = F.greatest(F.size(tokens) - 1, F.lit(0))
    plain = F.concat(F.array_repeat(F.lit(True), real), F.array_repeat(F.lit(False), F.greatest(F.lit(block), F.size(tokens)) - real))
    return F.when(~F.array_contains(tokens, pad), plain).otherwise(loss_mask(x, y, pad))


def samples(packs: DataFrame, block: int, bos: int, pad: int, tokens: str = "tokens") -> DataFrame:
    """x, y, doc_ids and loss_mask of each pack of at most `block` tokens, beside its other columns."""
    rest = [c for c in packs.columns if c != tokens]
    rows = packs.select(*rest, F.col(tokens).alias("_tokens"), padded(F.col(tokens), block, pad).alias("x"), shifted(F.col(tokens), block, pad).alias("y"))
    mask = sample_mask(F.col("_tokens"), F.col("x"), F.col("y"), block, pad)
    return rows.select(*rest, "x", "y", document_ids(F.col("x"), bos).alias("doc_ids"), mask.alias("loss_mask"))


SAMPLE = "x array<int>, y array<int>, doc_ids array<int>, loss_mask array<boolean>"
SUMMARY = "n_real int, n_pad int, x_sum long, y_sum long, n_loss int, last_doc int"


def _tables(tokens: np.ndarray, sizes: np.ndarray, block: int, bos: int, pad: int) -> tuple[np.ndarray, ...]:
    """Of documents laid out one after the other: each sample's document and chunk, then x, y, document numbers and loss mask, with a row for each sample."""
    chunks = -(-sizes // block)
    base = np.cumsum(chunks) - chunks
    x = np.full(int(chunks.sum()) * block, pad, np.int32)
    x[np.arange(len(tokens)) + np.repeat(base * block - (np.cumsum(sizes) - sizes), sizes)] = tokens
    x = x.reshape(-1, block)
    y = np.full_like(x, pad)
    y[:, :-1] = x[:, 1:]
    own = np.repeat(np.arange(len(sizes)), chunks)
    docs = np.maximum(np.cumsum(x == bos, axis=1, dtype=np.int32) - 1, 0)
    return own, (np.arange(len(own)) - base[own]).astype(np.int32), x, y, docs, (x != pad) & (y != pad)


def text_samples(docs: DataFrame, block: int, bos: int, pad: int, id_col: str = "doc_id", text_col: str = "text", summary: bool = False) -> DataFrame:
    """(id, chunk) and the sample of each chunk of `block` code points of a text, as samples() makes it of such chunks: one pass over flat arrays. With summary, of each sample only how many places are real, padding and in the loss, the sums of x and y, and the last place's document. Null and empty texts have none."""
    ship(docs.sparkSession)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text")).where("_text <> ''")
    kind = rows.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in (SUMMARY if summary else SAMPLE).split(", ")]

    def listed(table: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, block, dtype=np.int32)), pa.array(table.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, at = np.cumsum(lengths), 0
            while at < batch.num_rows:  # whole texts, some at once
                end = max(at + 1, int(np.searchsorted(upto, POINTS + (upto[at - 1] if at else 0), "right")))
                some = batch.slice(at, end - at)
                tokens = np.frombuffer("".join(some.column(1).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int32)
                own, chunk, x, y, places, mask = _tables(tokens, lengths[at:end], block, bos, pad)
                if summary:
                    real = (x != pad).sum(1, dtype=np.int32)
                    columns = [pa.array(c) for c in (real, block - real, x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64), mask.sum(1, dtype=np.int32), places[:, -1])]
                else:
                    columns = [listed(t) for t in (x, y, places, mask)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(own)), pa.array(chunk), *columns], [id_col, "chunk", *names])
                at = end

    return rows.mapInArrow(run, f"`{id_col}` {kind}, chunk int, {SUMMARY if summary else SAMPLE}")


def fixed_blocks(tokens: Column, block: int) -> Column:
    """array<struct<block, x, y>>: blocks that don't overlap, (n - 1) div block of them, with their successors."""
    n = F.floor((F.size(tokens) - 1) / F.lit(block)).cast("int")
    one = lambda i: F.struct(i.alias("block"), F.slice(tokens, i * block + 1, block).alias("x"), F.slice(tokens, i * block + 2, block).alias("y"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), one))


def random_start(tokens: Column, block: int, draw: Column) -> Column:
    """Where a run of `block` tokens begins, by a draw from [0, 1)."""
    return F.floor(draw * F.greatest(F.size(tokens) - block, F.lit(1))).cast("int")


def random_block(tokens: Column, block: int, draw: Column) -> Column:
    """A run of `block` tokens and its successor, at a place given by a draw from [0, 1)."""
    place = random_start(tokens, block, draw)
    return F.struct(F.slice(tokens, place + 1, block).alias("x"), F.slice(tokens, place + 2, block).alias("y"))


def pieces(lengths: DataFrame, block: int, n: str = "n") -> DataFrame:
    """Each document's pieces of at most `block` tokens, numbered by chunk, with their lengths as n, beside its other columns; an empty document, or one of no known length, is one empty piece."""
    rest = [c for c in lengths.columns if c != n]
    length = F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long"))
    rows = lengths.select(*rest, F.posexplode(chunk_starts(F.lit(0).cast("long"), length, block)).alias("chunk", "_piece"))
    return rows.select(*rest, F.col("chunk").cast("long").alias("chunk"), F.col("_piece.len").alias("n"))


def pack_next_fit(lengths: DataFrame, block: int, stream: str = "stream") -> DataFrame:
    """(stream, doc_id, n, pack, place): each document's pack within its stream and its place in it. Documents come in order of their ids; one that doesn't fit into what is left opens the next pack. n must be at most `block`: longer documents come as pieces(), whose chunk then follows doc_id in the order and the result."""
    order = ["doc_id", *(["chunk"] if "chunk" in lengths.columns else [])]
    found = bins.filled(lengths.select(F.col(stream).alias("stream"), *order, "n"), block + 1, order, "pack", most=block)
    return found.select("stream", *order, "n", "pack", "place")


def pack_texts(docs: DataFrame, block: int, stream: str = "stream", bos: str = "\x01") -> DataFrame:
    """(stream, pack, text): the texts of next-fit packs of at most `block` code points. Each document begins with `bos`, one sign, and is cut into pieces if it is longer than a pack; a null text is empty. Lengths alone are packed; texts move once, to their pack, which is bounded."""
    text = F.concat(F.lit(bos), F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.col(stream).cast("string").alias("stream"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    cut = scratch.saved(rows.select("stream", "doc_id", "row", F.posexplode(cut).alias("chunk", "text")).withColumn("n", F.length("text")), "pieces")
    placed = bins.filled(cut.select("stream", "doc_id", "row", "chunk", "n"), block + 1, ["doc_id", "row", "chunk"], "pack", most=block)
    joined = cut.select("row", "chunk", "text").join(placed.select("stream", "row", "chunk", "pack", "place"), ["row", "chunk"])
    pieces_ = F.array_sort(F.collect_list(F.struct("place", "text")))
    return joined.groupBy("stream", "pack").agg(F.array_join(F.transform(pieces_, lambda p: p["text"]), "").alias("text"))


def full_packs(packed: DataFrame) -> DataFrame:
    """Without each stream's last pack, which a finite reader never emits."""
    last = packed.groupBy("stream").agg(F.max("pack").alias("_last"))
    return packed.join(last, "stream").where("pack < _last").drop("_last")


def cut_shards(lengths: DataFrame, capacity: int, stream: str = "stream") -> DataFrame:
    """(stream, doc_id, n, shard, place): the shard in which each document begins and its place there. A shard that fills up is cut before its last document; a document longer than a shard runs on into the next ones."""
    found = bins.filled(lengths.select(F.col(stream).alias("stream"), "doc_id", "n"), capacity, ["doc_id"], "shard")
    return found.select("stream", "doc_id", "n", "shard", "place")

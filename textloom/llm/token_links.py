"""Alignment of two tokenizers' tokens by the bytes they end at.

Python tokenises: for a block of texts it gives the tokens and ends of both tokenizers over the distinct words, laid out one after
the other in rows of bounded size, and after these each text as places among the words. No token of either
spans the border before a space that follows another character, or between a letter and a stop (texts in which a border is in doubt
count as one word). Groups and links are built by Spark's higher-order functions, in the same stage: the ends that two arrays share
are sorted in among the tokens of each side and cut them into groups, and each distinct group of a row gives its links once. A second
pass of Python puts the words' groups and links together for each text. A pair's count is the number of documents that hold it
linked; pairs of many documents are looked up in a broadcast table of bounded size, all others by a join.

Nulls, ties and repeats: null and empty texts, and texts whose tokens don't spell them, have no
tokens: zeros and an empty digest; equally frequent partners of an id are all its best; rows that share an
id, or have none, are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from . import common, token_orc

#: Words that a Python worker remembers, besides those of one block; words encoded as one text; bytes of texts that share their words; bytes of words in a row; rows of words handed on at once; texts put together at once; pairs that are broadcast at most.
MEMO, RUN, TOGETHER, ROW, GIVEN, PUT, HEAD = 60_000, 500, 2 << 20, 1 << 16, 4, 250, 200_000
#: A link's code is the first id times this, plus the second; a token is where it starts times this, plus its id; an end is the number before its place times this. Ids must be below END.
SECOND = 1 << 20
#: What is left of an end without its place.
END = SECOND - 1
#: Fixed value: what stands for a space in the pieces.
SPACE = "▁"
#: Letters after which a stop begins a word of its own; a sign that marks words' borders, and is in no text that is cut.
LETTERS, MARK = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\x00"

#: Rows of words have the tokens and ends of both sides and where the words end; rows of texts have the other columns.
_LONGS = K.ArrayType(K.LongType(), False)
BLOCK = K.StructType([*[K.StructField(n, K.LongType()) for n in ("row", "doc_id", "n_a", "n_b")], K.StructField("places", K.ArrayType(K.IntegerType(), False)), *[K.StructField(n, _LONGS) for n in ("a", "ends_a", "b", "ends_b", "ends")]])
_BLOCK = pa.schema([*[(n, pa.int64()) for n in ("row", "doc_id", "n_a", "n_b")], ("places", pa.list_(pa.int32())), *[(n, pa.list_(pa.int64())) for n in ("a", "ends_a", "b", "ends_b", "ends")]])
DOCUMENT = K.StructType([*[K.StructField(n, K.LongType()) for n in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")], K.StructField("groups_sha256", K.StringType()), K.StructField("links", _LONGS)])


#: Ids of some words, one after the other, and where each word's begin and the last ones end.
Ids = tuple[np.ndarray, np.ndarray]


class _Side:
    """The bytes that a tokenizer's ids stand for."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = pa.array(tokens, pa.large_binary())
        self.sizes = np.array([len(t) for t in tokens], np.int64)

    def spell(self, ids: Ids, words: pa.Array) -> np.ndarray:
        """Whether each word's ids spell it."""
        flat, borders = ids
        cuts = np.concatenate([[0], np.cumsum(self.sizes[flat])])[borders]
        found = self.tokens.take(pa.array(flat)).buffers()[2]
        data = b"" if found is None else memoryview(found).cast("B")[: cuts[-1]]
        if np.array_equal(np.diff(cuts), pc.binary_length(words).to_numpy(zero_copy_only=False)) and np.array_equal(np.frombuffer(data, np.uint8), np.frombuffer(_bytes(words), np.uint8)):
            return np.ones(len(words), bool)
        return np.array([data[x:y] == w for w, x, y in zip(words.to_pylist(), cuts, cuts[1:])], bool)


def _bytes(words: pa.Array) -> memoryview:
    """All words, one after the other."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    found = words.buffers()[2]
    return memoryview(b"" if found is None else found)[ends[0] : ends[-1]]


def _flat(ids: list[list[int]]) -> Ids:
    ends = np.fromiter(accumulate(map(len, ids), initial=0), np.int64, len(ids) + 1)
    return np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]), ends


def _after(*parts: Ids) -> Ids:
    """The words of several parts, one part after the other."""
    cuts = np.cumsum([0, *[len(flat) for flat, _ in parts]])
    return np.concatenate([flat for flat, _ in parts]), np.concatenate([[0], *[at + ends[1:] for at, (_, ends) in zip(cuts, parts)]])


class Tokenizers:
    """Both tokenizers with the ids of recent words."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        self.encoder = token_orc.Encoder(bytes_path, 0)
        tokenizer = self.encoder.tokenizer
        tokenizer.encode_special_tokens = True
        sign = _signs()
        vocabulary = tokenizer.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(map(sign.__getitem__, token)) if all(c in sign for c in token) else token.encode()
        self.first = _Side(tokens)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        stops = re.escape(token_orc.STOPS)
        across = re.compile(rf"[^{SPACE}]{SPACE}|[{LETTERS}][{stops}]")
        if any(across.search(p) for i, p in enumerate(names) if not (self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i))):
            raise ValueError("a piece spans a space or a stop after another character, so texts can't be cut into words")
        self.second = _Side([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])
        if max(len(tokens), len(names)) > END:
            raise ValueError(f"ids must be below {END}")
        self.stop = f"([{LETTERS}])([{stops}])"
        self.doubtful = "|".join([self.encoder.doubtful, r"\A ", SPACE, r"\x00"])
        self.known, self.hits = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.sides = [_flat([]), _flat([])]

    def whole(self, texts: list[str]) -> list[Ids]:
        """Ids of texts with a space before each, which the pieces' library adds by itself."""
        return [self.encoder._flat([" " + t for t in texts]), _flat(self.pieces.encode(texts, num_threads=1))] if texts else [_flat([]), _flat([])]

    def ids(self, words: pa.Array, times: np.ndarray) -> list[Ids]:
        """Ids of distinct words: those with a space before them, and those that begin with a stop and follow a letter. Words that occur once aren't remembered, and those that few blocks hold are forgotten first."""
        if len(self.known) > MEMO:
            kept = np.sort(np.argsort(self.hits, kind="stable")[-(MEMO // 2) :])
            self.known, self.hits = self.known.take(pa.array(kept)), self.hits[kept] >> 1
            self.sides = [token_orc.taken(*x, kept) for x in self.sides]
        at = pc.index_in(words, value_set=self.known)
        gaps = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        new = words.take(pa.array(gaps))
        spaced = pc.starts_with(new, " ").to_numpy(zero_copy_only=False)
        open_end = pc.match_substring_regex(new, rf"[{token_orc.SPACES}]\z").to_numpy(zero_copy_only=False)
        order = np.argsort(np.where(spaced, np.where(open_end, 1, 0), 2), kind="stable")
        bare, ended, after = (new.filter(pa.array(x)) for x in (spaced & ~open_end, spaced & open_end, ~spaced))
        bare = pc.utf8_slice_codeunits(bare, 1)
        parts = [[self.encoder._runs(bare), self._runs(bare)], self.whole([x[1:] for x in ended.to_pylist()])]
        if len(after):  # the first piece is the letter before
            after = after.to_pylist()
            parts.append([self.encoder._flat(after), _flat([x[1:] for x in self.pieces.encode(["a" + x for x in after], num_threads=1)])])
        learned = [_after(*x) for x in zip(*parts)]
        self.hits[at[np.setdiff1d(np.arange(len(words)), gaps, assume_unique=True)]] += 2
        at[gaps[order]] = len(self.known) + np.arange(len(gaps))
        found = [token_orc.taken(*_after(x, y), at) for x, y in zip(self.sides, learned)]
        often = np.flatnonzero(times[gaps[order]] > 1)
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order[often]))])
        self.hits = np.concatenate([self.hits, np.full(len(often), 2)])
        self.sides = [_after(x, token_orc.taken(*y, often)) for x, y in zip(self.sides, learned)]
        return found

    def _runs(self, words: pa.Array) -> Ids:
        """Pieces' ids of words, which are encoded in runs; the bytes that ids stand for tell where each ends."""
        out = [_flat([])]
        for at in range(0, len(words), RUN):
            run = words.slice(at, RUN)
            ids = np.array(self.pieces.encode(" ".join(run.to_pylist())), np.int32)
            ends = np.cumsum(self.second.sizes[ids])
            stops = np.cumsum(pc.binary_length(run).to_numpy() + 1)
            last = np.minimum(np.searchsorted(ends, stops), len(ends) - 1)
            if np.array_equal(ends[last], stops):
                out.append((ids, np.concatenate([[0], last + 1])))
            else:  # never so with pieces that spell their text
                out.append(_flat(self.pieces.encode(run.to_pylist(), num_threads=1)))
        return _after(*out)

    def block(self, rows: pa.Array, doc_ids: pa.Array, texts: pa.Array) -> list[pa.RecordBatch]:
        """Rows of the distinct words of some texts, and the texts as places among them."""
        texts = pc.fill_null(texts, "")
        doubt = pc.match_substring_regex(texts, self.doubtful)
        cut = pc.and_not(pc.greater(pc.binary_length(texts), 0), doubt)
        marked = pc.replace_substring_regex(pc.replace_substring(texts.filter(cut), " ", MARK + " "), self.stop, rf"\1{MARK}\2")
        parts = pc.split_pattern(pc.binary_join_element_wise(" ", marked, ""), MARK)
        coded, pieces_of = parts.flatten().dictionary_encode(), pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        del marked, parts
        alone = texts.filter(doubt)
        words = pa.concat_arrays([coded.dictionary, pc.binary_join_element_wise(" ", alone, "")]).cast(pa.binary())
        cut_ids = self.ids(coded.dictionary, np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)))
        firsts, seconds = (_after(*x) for x in zip(cut_ids, self.whole(alone.to_pylist())))
        fine = self.first.spell(firsts, words) & self.second.spell(seconds, words)
        cut, doubt = (x.to_numpy(zero_copy_only=False) for x in (cut, doubt))
        sizes = doubt.astype(np.int64)
        sizes[cut] = pieces_of
        text_of = np.repeat(np.arange(len(texts)), sizes)
        which = np.empty(len(text_of), np.int64)
        which[~doubt[text_of]] = coded.indices.to_numpy(zero_copy_only=False)
        which[doubt[text_of]] = len(coded.dictionary) + np.arange(len(alone))
        if not fine.all():  # a text with such a word has no tokens
            wrong = np.bincount(text_of, weights=~fine[which], minlength=len(texts)) > 0
            which, text_of = which[~wrong[text_of]], text_of[~wrong[text_of]]
            which = (np.cumsum(fine) - 1)[which]
            firsts, seconds = (token_orc.taken(*side, np.flatnonzero(fine)) for side in (firsts, seconds))
            words = words.filter(pa.array(fine))
        totals = [np.bincount(text_of, weights=np.diff(ends)[which], minlength=len(texts)).astype(np.int64) for _, ends in (firsts, seconds)]
        ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
        borders = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(ROW, ends[-1] if len(ends) else 0, ROW)) + 1, [len(ends)]])).astype(np.int64)
        lists = []
        for side, (flat, at) in ((self.first, firsts), (self.second, seconds)):
            high = np.cumsum(side.sizes[flat])
            cuts = at[borders]
            lists += [_lists(cuts, (high - side.sizes[flat]) * SECOND + flat), _lists(cuts, high * SECOND - 1)]
        lists.append(_lists(borders, ends * SECOND - 1))
        starts = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(texts)))])
        n, none = len(borders) - 1, lambda kind, size: pa.nulls(size, kind)
        out = [pa.RecordBatch.from_arrays([*[none(f.type, n) for f in list(_BLOCK)[:5]], *lists], schema=_BLOCK)] if n else []
        docs = [rows, doc_ids, *map(pa.array, totals), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(which.astype(np.int32)))]
        return [*out, pa.RecordBatch.from_arrays([*docs, *[none(f.type, len(texts)) for f in list(_BLOCK)[5:]]], schema=_BLOCK)]


def _lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int64)))


def _signs() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable Latin-1 for itself, from 256 on the other bytes."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _tokenise(bytes_path: str, pieces_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tokenizers(bytes_path, pieces_path)
        for block in _blocks(batches):
            with common.uncollected():
                out = own.block(*block.columns)
            for rows in out[:-1]:
                yield from (rows.slice(k, GIVEN) for k in range(0, rows.num_rows, GIVEN))
            yield out[-1]
            del block, out
            common.released()  # while it waits, the JVM goes on to count links
        # a worker that waits for its next task holds nothing
        del own
        common.released()

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows one after the other, as many together as have about TOGETHER bytes."""
    for batch in batches:
        size = max(1, -(-batch.num_rows // max(1, round(batch.nbytes / TOGETHER))))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


class _Words:
    """The groups and links of a block's words, as they come in rows, and its texts put together from them."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, pa.Array, pa.Array]] = []
        self.held: tuple[np.ndarray, pa.Array, pa.Array] | None = None

    def add(self, row: dict[str, pa.Array]) -> None:
        """Word by word: how many groups, their text, their links."""
        if self.held is not None:
            self.rows, self.held = [], None
        groups, distinct, codes = (row[n].values for n in ("groups", "distinct", "codes"))
        cuts = np.concatenate([[0], np.searchsorted(row["shared"].values.to_numpy(), row["ends"].values.to_numpy(), "right")]).astype(np.int32)
        own = codes.take(pc.index_in(groups, distinct))
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), groups), ";").cast(pa.large_string())
        self.rows.append((np.diff(cuts), text, pa.ListArray.from_arrays(pa.array(own.offsets.to_numpy()[cuts]), own.values)))

    def texts(self, docs: pa.RecordBatch) -> pa.RecordBatch:
        if self.held is None:
            none = (np.zeros(0, np.int32), pa.array([], pa.large_string()), pa.array([], pa.list_(pa.int64())))
            self.held = tuple(join([r[k] for r in self.rows] or [none[k]]) for k, join in enumerate((np.concatenate, pa.concat_arrays, pa.concat_arrays)))
            self.rows = []
        sizes, texts, codes = self.held
        places, at = docs.column("places").flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(docs.column("places")).to_numpy())]).astype(np.int64)
        text = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), texts.take(places)), pa.scalar(";", pa.large_string()))
        digests = [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(text.cast(pa.large_binary()), docs.column("n_a").to_pylist())]
        links = codes.take(places)
        ends = links.offsets.to_numpy().astype(np.int64)[at]
        groups = np.diff(np.concatenate([[0], np.cumsum(sizes[places.to_numpy()], dtype=np.int64)])[at])
        columns = [*docs.columns[:4], pa.array(groups), pa.array(np.diff(ends)), pa.array(digests, pa.string()), _lists(ends - ends[0], links.values.to_numpy()[ends[0] : ends[-1]])]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        kinds = batch.column("shared").is_valid().to_numpy(zero_copy_only=False)
        borders = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), batch.num_rows]
        for low, high in zip(borders, borders[1:]):
            if low == high:
                continue
            if kinds[low]:
                for k in range(low, high):
                    words.add({n: batch.column(n)[k] for n in ("shared", "groups", "distinct", "codes", "ends")})
            else:
                for k in range(low, high, PUT):
                    yield words.texts(batch.slice(k, min(PUT, high - k)))
    del words
    common.released()


# --- Spark's higher-order functions


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once. A column that a lambda looks into must be bound so, or Spark may compute it anew for every element."""
    return F.transform(F.array(value), use)[0]


def _grouped(side: str) -> Column:
    """The ids of each group of one side, joined by commas: the shared ends, sorted in among the tokens, cut them."""
    ids = F.transform(side, lambda x: x.bitwiseAND(END))
    return F.split(F.regexp_replace(F.array_join(ids.cast("array<string>"), ","), f",{END}$", ""), f",{END},")


def _links(group: Column) -> Column:
    """All pairs of a group's tokens."""
    sides = F.transform(F.split(group, r"\|"), lambda x: F.split(x, ",").cast("array<long>"))
    none = F.array().cast("array<long>")
    return _once(sides, lambda s: F.aggregate(s[0], none, lambda found, x: F.concat(found, F.transform(s[1], lambda y: x * SECOND + y))))


def documents_of(blocks: DataFrame) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the links, sorted, of each document."""
    rest = ("row", "doc_id", "n_a", "n_b", "places", "ends", "shared")
    # a column that is used twice is computed in a step of its own, by generated code; within a higher-order function all is interpreted
    shared = blocks.withColumn("shared", F.array_intersect("ends_a", "ends_b"))
    sorted_in = shared.select(*rest, *[F.sort_array(F.concat(n, "shared")).alias(n) for n in ("a", "b")])
    cut = sorted_in.select(*rest, *[F.when(F.size(n) > 0, _grouped(n)).alias(n) for n in ("a", "b")])
    groups = cut.select(*rest, F.when(F.size("a") > 0, F.zip_with("a", "b", lambda x, y: F.concat(x, F.lit("|"), y))).alias("groups"))
    distinct = groups.select("*", F.array_distinct("groups").alias("distinct"))
    linked = distinct.select("*", F.transform("distinct", _links).alias("codes"))
    return linked.mapInArrow(_together, DOCUMENT).withColumn("links", F.sort_array("links"))


def frequent(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of the highest counts, as many whole counts as stay within the bound."""
    total, least = 0, None
    for n, size in pairs.groupBy("n").count().orderBy(F.desc("n")).limit(most).toLocalIterator():
        if total + size > most:
            break
        total, least = total + size, n
    return pairs.where(F.lit(False) if least is None else F.col("n") >= least)


def token_links(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    common.tune(docs.sparkSession)
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    aligned = common.saved(documents_of(given.mapInArrow(_tokenise(bytes_path, pieces_path), BLOCK)), "aligned")
    counted = common.saved(aligned.select(F.explode(F.array_distinct("links")).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.shiftright("code", SECOND.bit_length() - 1).alias("a")
    best = counted.groupBy(a).agg(F.max("n").alias("most"))
    pairs = common.saved(counted.select("code", "n", a).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("best")), "best")
    few = frequent(pairs, head)
    links = aligned.select("row", F.explode("links").alias("code"))
    sums = [F.sum("best").alias("n_best"), F.sum("n").alias("count_sum")]
    found = links.join(F.broadcast(few), "code").groupBy("row").agg(*sums)
    rest = pairs.join(F.broadcast(few.select("code")), "code", "left_anti")
    if not rest.isEmpty():
        # rare pairs alone are left, so no code is hot
        others = links.join(F.broadcast(few.select("code")), "code", "left_anti").join(rest, "code").groupBy("row").agg(*sums)
        found = found.unionByName(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    joined = aligned.drop("links").join(found, "row", "left")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")

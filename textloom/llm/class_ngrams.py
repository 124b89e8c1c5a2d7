"""LM scoring with Brown class-based bigrams.

Word counts come from all training documents. The words of the vocabulary, which grows with the
corpus, and the endings of all rarer ones, are symbols; exchange clustering assigns the symbols, and
so every word, known or not, to classes. The most frequent words and the endings, the core, are
exchanged first, on the driver; then sweeps over all symbols follow, in which tasks exchange the
words whose neighbours they hold and the driver exchanges the core. Texts are cut into words twice, to count
them and to write them as symbols, from which all else is counted and scored. A text's probability is the product of class transitions and of word emissions within
the classes, both smoothed so that they sum to one.

Nulls, ties and repeats: a null text is empty and is its end token alone; a row with a null id is
learned from and not held out; ties in frequency go to the word that sorts first; repeated rows
count each time; an empty table gives no rows, and without training rows every probability is the
smoothed one of an empty corpus; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of the vocabulary, and classes, at least; words of the core; endings; sweeps of exchange.
HEAD, WORDS, ENDINGS, CLASSES, SWEEPS = 150_000, 500, 128, 48, 8
#: The vocabulary has this many words per square root of the tokens; the classes are the square root of its size by this.
GROWTH, PER_CLASS = 20, 8
#: Tokens whose pairs a task counts at once, tokens to a part of the neighbours, entries to a block, words exchanged at once, and the relative gain below which sweeps end.
RUN, PART, BLOCK, TOGETHER, LEAST_GAIN = 2_000_000, 2_000_000, 200_000, 64, 1e-5
#: Words that a task counts before it hands them on; added counts; weight of the class shares in transitions.
FLUSH, ADDED, BACK_OFF = 250_000, 0.1, 50.0
#: Within the core: the end token is the last symbol and the last class.
END = WORDS + ENDINGS
SYMBOLS = END + 1


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, in lower case for A-Z."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """The core symbol of a word that isn't one itself: a bucket of its last three bytes."""
    return WORDS + zlib.crc32(word[-3:]) % ENDINGS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, counts = list(found), list(found.values())
        for at in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 50_000], pa.binary()).cast(pa.string()), pa.array(counts[at : at + 50_000], pa.int64())], ["word", "n"])
        found.clear()

    for batch in batches:
        for text in common.bytes_of(batch.column(0)):
            found.update(words_of(text))
        if len(found) > FLUSH:
            yield from out()
    yield from out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and n over all rows of a text column."""
    return texts.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words of the highest counts, as many whole counts as stay within the bound, sorted by falling count."""
    total, least = 0, None
    for n, words in counts.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect():
        if total + words > most:
            break
        total, least = total + words, n
    if least is None:
        return []
    return sorted(((r["word"], r["n"]) for r in counts.where(F.col("n") >= least).collect()), key=lambda x: (-x[1], x[0]))


class Symbols:
    """Numbers of symbols: the words of the vocabulary by falling count, the endings, the end token; and the core's symbol of each."""

    def __init__(self, words: list[str]):
        self.word = {w.encode(): k for k, w in enumerate(words)}
        self.size = len(words)
        self.core = np.arange(self.size + ENDINGS + 1) - self.size + WORDS
        self.core[: self.size] = [k if k < WORDS else ending(w.encode()) for k, w in enumerate(words)]

    def of(self, words: list[bytes]) -> np.ndarray:
        rest = self.size - WORDS
        return np.array([s if (s := self.word.get(w)) is not None else rest + ending(w) for w in words], np.int64)

    def in_core(self, symbols: np.ndarray) -> np.ndarray:
        return (symbols < WORDS) | (symbols >= self.size)

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Coded texts, each between two end tokens, many texts at once."""
        end, rows, n = np.array([self.size + ENDINGS]), [], 0
        for batch in batches:
            for found in read_symbols(batch.column(0)):
                rows += [end, found, end]
                n += len(found) + 2
                if n > RUN:
                    yield np.concatenate(rows)
                    rows, n = [], 0
        if rows:
            yield np.concatenate(rows)


def read_symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.int32) for x in column]


CODED = "row long, doc_id long, held_out boolean, symbols binary, rare array<struct<word: binary, n: bigint>>"


def _code(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, row = shared.value, TaskContext.get().partitionId() << 33
        kinds = (pa.binary(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
        for batch in batches:
            coded, rare = [], []
            for text in common.bytes_of(batch.column(2)):
                words = words_of(text)
                found = symbols.of(words)
                coded.append(found.astype(np.int32).tobytes())
                rare.append([{"word": w, "n": n} for w, n in Counter(words[k] for k in np.flatnonzero(found >= symbols.size)).items()])
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:2], *map(pa.array, (coded, rare), kinds)], ["row", "doc_id", "held_out", "symbols", "rare"])

    return run


def coded_texts(given: DataFrame, shared) -> DataFrame:
    """row, doc_id, held_out, the symbols of each text, and its words outside the vocabulary with how often it has them; of doc_id, held_out and a text column."""
    return common.saved(given.mapInArrow(_code(shared), CODED), "symbols")


def _steps(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a run, without the borders between texts."""
    end = flat.max()
    left, right = flat[:-1], flat[1:]
    # end tokens open and close texts in turn; a closing one and the next opening one are no transition
    ends = np.flatnonzero(flat == end)
    inner = np.ones(len(left), bool)
    inner[ends[1:-1:2]] = False
    return left[inner], right[inner]


def _pairs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, cells = shared.value, SYMBOLS * SYMBOLS
        total = np.zeros(2 * cells, np.int64)
        for flat in symbols.runs(batches):
            left, right = _steps(flat)
            code = symbols.core[left] * SYMBOLS + symbols.core[right]
            total[:cells] += np.bincount(code, minlength=cells)
            total[cells:] += np.bincount(code[symbols.in_core(left) & symbols.in_core(right)], minlength=cells)
        at = np.flatnonzero(total)
        for low in range(0, len(at), 100_000):
            part = at[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["pair", "n"])

    return run


def pair_counts(coded: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """How often each core symbol follows each other one, over all rows of a column of coded texts, with the vocabulary's other words counted as their endings, and without them; a text begins and ends with the end token."""
    counts = np.zeros(2 * SYMBOLS * SYMBOLS)
    for pair, n in coded.mapInArrow(_pairs(shared), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[pair] = n
    both = counts.reshape(2, SYMBOLS, SYMBOLS)
    return both[0], both[1]


NEIGHBOURS = "part int, word binary, other binary, n binary"


def _entries(code: np.ndarray, n: np.ndarray, size: int) -> list[bytes]:
    """Words, their neighbours (~ of those before them) and counts, from codes."""
    word, other = np.divmod(code, 2 * size)
    other = np.where(other < size, other, size - 1 - other)
    return [x.astype(np.int32).tobytes() for x in (word, other, n)]


def _read(row: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in row]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "word", "other", "n"])


def _neighbours(shared, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = shared.value
        size = len(symbols.core)
        for flat in symbols.runs(batches):
            left, right = _steps(flat)
            a, b = ~symbols.in_core(left), ~symbols.in_core(right)
            code = np.concatenate([left[a] * (2 * size) + right[a], right[b] * (2 * size) + size + left[b]])
            code, n = np.unique(code, return_counts=True)
            part = code // (2 * size) % parts
            order = np.argsort(part, kind="stable")
            code, n, part = code[order], n[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(code)]):
                if high > low:
                    yield _blobs([(int(part[low]), *_entries(code[low:high], n[low:high], size))])

    return run


def _merge(size: int):
    """Entries of one part brought together, in blocks that end with a word's last entry."""

    def blocks(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        word, other, n = (np.concatenate(x) for x in zip(*[_read(r) for r in rows]))
        code, back = np.unique(word.astype(np.int64) * (2 * size) + np.where(other >= 0, other, size - 1 - other.astype(np.int64)), return_inverse=True)
        n = np.bincount(back, weights=n, minlength=len(code)).astype(np.int64)
        first = np.append(np.flatnonzero(np.diff(code // (2 * size), prepend=-1)), len(code))
        low = 0
        while low < len(code):
            high = int(first[min(np.searchsorted(first, low + BLOCK), len(first) - 1)])
            yield _blobs([(part, *_entries(code[low:high], n[low:high], size))])
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            for part, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if part != last and rows:
                    yield from blocks(last, rows)
                    rows = []
                last = part
                rows.append(row)
        if rows:
            yield from blocks(last, rows)

    return run


def neighbours(coded: DataFrame, shared, tokens: int) -> DataFrame:
    """Blocks of the words outside the core with how often every symbol follows and precedes each; a word stands in one block only."""
    parts = max(8, tokens // PART)
    found = coded.mapInArrow(_neighbours(shared, parts), NEIGHBOURS)
    return common.saved(found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_merge(len(shared.value.core)), NEIGHBOURS), "neighbours")


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol: one after the other moves to the class that raises the likelihood of the class bigrams most, until none gains. The last symbol keeps a class of its own."""
    n, k = len(pairs), classes - 1
    own = np.argsort(np.argsort(-pairs.sum(1)[:-1], kind="stable"), kind="stable") % k
    own = np.append(own, k)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    table = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for w in range(n - 1):
            out, into, both = pairs[w] @ member, pairs[:, w] @ member, pairs[w, w]
            a = own[w]
            out[a] -= both
            into[a] -= both
            if not both and not out.any() and not into.any():
                continue
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= both
            member[w, a] = 0
            rows, columns = table.sum(1) + into, table.sum(0) + out  # the others' pairs with w count wherever it goes
            diagonal = np.diag(table)
            gain = (_f(table + out) - _f(table)).sum(1) + (_f(table + into[:, None]) - _f(table)).sum(0)
            gain -= _f(diagonal + out) - _f(diagonal) + _f(diagonal + into) - _f(diagonal)
            gain += _f(diagonal + out + into + both) - _f(diagonal)
            total_out, total_in = out.sum() + both, into.sum() + both
            gain -= _f(rows + total_out) - _f(rows) + _f(columns + total_in) - _f(columns)
            b = int(np.argmax(gain[:k]))
            b = a if gain[b] <= gain[a] + 1e-9 else b
            own[w], moved = b, moved + (a != b)
            member[w, b] = 1
            table[b] += out
            table[:, b] += into
            table[b, b] += both
        if not moved:
            break
    return own


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values added up by a sorted index."""
    out = np.zeros((n, values.shape[1]))
    if len(index):
        first = np.flatnonzero(np.diff(index, prepend=-1))
        out[index[first]] = np.add.reduceat(values, first, axis=0)
    return out


def gains(table: np.ndarray, rows: np.ndarray, columns: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, both: np.ndarray) -> np.ndarray:
    """For each of some symbols, whose classes are `own`, and each class: the likelihood of the class bigrams if the symbol were there, less that without it. `out` and `into` count its pairs by the others' class, `both` those with itself; rows and columns are the table's sums."""
    n = len(own)
    at = np.arange(n)
    gain = np.zeros(out.shape)
    for grid, mine, back in ((table.T, out, into), (table, into, out)):
        i, c = np.nonzero(mine)
        rest, count = grid[c].astype(float), mine[i, c]
        home = np.flatnonzero(c == own[i])
        rest[home] -= back[i[home]]
        rest[np.arange(len(i)), own[i]] -= count
        rest[home, c[home]] -= both[i[home]]
        gain += _sums(i, _f(rest + count[:, None]) - _f(rest), n)
    diagonal = np.repeat(np.diag(table)[None].astype(float), n, 0)
    diagonal[at, own] -= out[at, own] + into[at, own] + both
    gain += _f(diagonal) - _f(diagonal + out) - _f(diagonal + into) + _f(diagonal + out + into + both[:, None])
    for total, mine in ((rows, out), (columns, into)):
        own_total = mine.sum(1) + both
        rest = np.repeat(total[None].astype(float), n, 0)
        rest[at, own] -= own_total
        gain -= _f(rest + own_total[:, None]) - _f(rest)
    return gain


def _moved(table: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The best classes of some symbols; the table follows them. The last class takes none."""
    gain = gains(table, table.sum(1), table.sum(0), own, out, into, both)[:, :-1]
    at = np.arange(len(own))
    best = gain.argmax(1)
    best = np.where(gain[at, best] > gain[at, own] + 1e-9, best, own)
    for k in np.flatnonzero(best != own):
        for c, sign in ((own[k], -1), (best[k], 1)):
            table[c] += sign * out[k]
            table[:, c] += sign * into[k]
            table[c, c] += sign * both[k]
    return best


def _per_class(row: list[bytes], own: np.ndarray, classes: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a block, some words at once: the words, and their out, into and both."""
    word, other, n = _read(row)
    first = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
    for k in range(0, len(first) - 1, TOGETHER):
        cut = first[k : k + TOGETHER + 1]
        low, high, size = cut[0], cut[-1], len(cut) - 1
        w, v, m = word[low:high], other[low:high], n[low:high]
        place = np.repeat(np.arange(size), np.diff(cut))
        after = v >= 0
        v = np.where(after, v, ~v)
        self = v == w
        sides = [np.bincount(place[t] * classes + own[v[t]], weights=m[t], minlength=size * classes).reshape(size, classes) for t in (after & ~self, ~after & ~self)]
        yield word[cut[:-1]], *sides, np.bincount(place[self & after], weights=m[self & after], minlength=size)


def _sweep(shared):
    """Exchange the words of each block, from the same classes and table for all blocks: which block a task holds, and after which others, plays no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *row in zip(*[c.to_pylist() for c in batch.columns]):
                own, table = (x.copy() for x in shared.value)
                words, classes = [], []
                for word, out, into, both in _per_class(row, own, len(table)):
                    best = _moved(table, own[word], out, into, both)
                    there = np.flatnonzero(best != own[word])
                    words.append(word[there])
                    classes.append(best[there])
                    own[word] = best
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).astype(np.int32).tobytes()], pa.binary()) for x in (words, classes)], ["word", "class"])

    return run


def _tables(shared, core: np.ndarray, size: int, classes: int):
    """Pairs of classes, and of core symbols with classes on either side, without the pairs within the core."""
    shape = (classes + 2 * SYMBOLS, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(shape[0] * shape[1])
        for batch in batches:
            for _, *row in zip(*[c.to_pylist() for c in batch.columns]):
                word, other, n = _read(row)
                after = other >= 0
                v = np.where(after, other, ~other)
                held = (v < WORDS) | (v >= size)
                w = own[word].astype(np.int64)
                at = [own[word[after]].astype(np.int64) * classes + own[v[after]], own[v[~after & held]].astype(np.int64) * classes + w[~after & held]]
                # what follows a core symbol, then what precedes it
                at += [(classes + core[v[t]] + k * SYMBOLS) * classes + w[t] for k, t in enumerate((~after & held, after & held))]
                weights = [n[t] for t in (after, ~after & held, ~after & held, after & held)]
                total += np.bincount(np.concatenate(at), weights=np.concatenate(weights), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = np.frombuffer(x) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])


def class_table(blocks: DataFrame, symbols: Symbols, own: np.ndarray, inner: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """The class bigrams over all pairs; and of each core symbol, by class, the words outside the core that follow it and that precede it."""
    context = blocks.sparkSession.sparkContext
    found = blocks.mapInArrow(_tables(context.broadcast(own), symbols.core, symbols.size, classes), "total binary").repartition(8).mapInArrow(_added, "total binary")
    total = np.zeros((classes + 2 * SYMBOLS, classes))
    for row in found.toLocalIterator():
        total += np.frombuffer(row["total"]).reshape(total.shape)
    member = np.eye(classes)[_core_own(symbols, own)]
    return total[:classes] + member.T @ inner @ member, total[classes : classes + SYMBOLS], total[classes + SYMBOLS :]


def _core_at(symbols: Symbols) -> np.ndarray:
    """The symbols of the core; -1 where a small vocabulary has none."""
    return np.array([*[k if k < symbols.size else -1 for k in range(WORDS)], *range(symbols.size, len(symbols.core))])


def _core_own(symbols: Symbols, own: np.ndarray) -> np.ndarray:
    at = _core_at(symbols)
    return np.where(at >= 0, own[at], 0)


def _likelihood(table: np.ndarray) -> float:
    return float(_f(table).sum() - _f(table.sum(0)).sum() - _f(table.sum(1)).sum())


def clustered(coded: DataFrame, shared, tokens: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each symbol and the class bigrams. Tasks exchange side by side, so a sweep that lowers the likelihood isn't kept."""
    symbols, context = shared.value, coded.sparkSession.sparkContext
    seen, inner = pair_counts(coded, shared)
    own = exchange(seen, classes)[symbols.core].astype(np.int16)
    blocks, at = neighbours(coded, shared, tokens), _core_at(symbols)
    table, after, before = class_table(blocks, symbols, own, inner, classes)
    for _ in range(SWEEPS):
        new, moving = own.copy(), table.copy()
        for k in np.flatnonzero(at[:-1] >= 0):
            mine = _core_own(symbols, new)
            others = np.arange(SYMBOLS) != k
            out = after[k] + np.bincount(mine[others], weights=inner[k, others], minlength=classes)
            into = before[k] + np.bincount(mine[others], weights=inner[others, k], minlength=classes)
            new[at[k]] = _moved(moving, new[at[k : k + 1]], out[None], into[None], inner[k, k : k + 1])[0]
        for row in blocks.mapInArrow(_sweep(context.broadcast((new, moving))), "word binary, class binary").toLocalIterator():
            word, where = _read(row)
            new[word] = where
        found = class_table(blocks, symbols, new, inner, classes)
        gain = _likelihood(found[0]) - _likelihood(table)
        if gain <= 0:
            break
        own, (table, after, before) = new, found
        if gain < LEAST_GAIN * abs(_likelihood(table)):
            break
    common.drop(blocks)
    return own, table


def transitions(pairs: np.ndarray, own: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """log10 of the probability of each class after each other one, smoothed by the classes' shares."""
    member = np.zeros((len(own), classes))
    member[np.arange(len(own)), own] = 1
    return smoothed(member.T @ pairs @ member)


def smoothed(table: np.ndarray) -> np.ndarray:
    """The same from the table of class bigrams."""
    classes = len(table)
    share = (table.sum(0) + ADDED) / (table.sum() + ADDED * classes)
    return np.log10((table + BACK_OFF * share) / (table.sum(1, keepdims=True) + BACK_OFF))


class Model:
    """Vocabulary with classes and counts, classes of the endings, transitions, and the log10 denominators of emissions and of the base."""

    def __init__(self, symbols: Symbols, counts: list[int], own: np.ndarray, table: np.ndarray):
        self.word, self.own, self.steps = symbols.word, own, smoothed(table)
        self.logs = np.log10(np.array(counts, float) + ADDED)
        self.denominators = np.zeros(len(table))

    def class_of(self, word: bytes) -> int:
        found = self.word.get(word)
        return int(self.own[len(self.word) - WORDS + ending(word) if found is None else found])


def vocabulary(counts: DataFrame, tokens: int) -> tuple[list[int], object]:
    """The counts of the vocabulary's words, and its symbols, shared. The vocabulary grows with the tokens."""
    head = frequent(counts, max(HEAD, int(GROWTH * math.sqrt(tokens))))
    return [n for _, n in head], counts.sparkSession.sparkContext.broadcast(Symbols([w for w, _ in head]))


def learned(train: DataFrame, counts: DataFrame, tokens: int, known: tuple[list[int], object] | None = None) -> Model:
    """The model of a text column and its word counts, yet without denominators; or of a column of texts coded by a known vocabulary. The number of classes grows with the vocabulary."""
    heads, shared = known or vocabulary(counts, tokens)
    if known is None:
        train = coded_texts(train.select(F.lit(None).cast("long"), F.lit(False), train.columns[0]), shared).select("symbols")
    classes = max(CLASSES, int(math.sqrt(shared.value.size) / PER_CLASS))
    return Model(shared.value, heads, *clustered(train, shared, tokens, classes))


def _class_sizes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(shared.value.denominators)
        tokens, types = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            own = np.array([shared.value.class_of(w) for w in common.bytes_of(batch.column(0))], np.int64)
            tokens += np.bincount(own, weights=batch.column(1).to_numpy(), minlength=classes).astype(np.int64)
            types += np.bincount(own, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(tokens), pa.array(types)], ["class", "tokens", "types"])

    return run


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            columns: list[list] = [[] for _ in range(4)]
            for found in read_symbols(batch.column(3)):
                head = found[found < len(model.word)]
                own = np.full(len(found) + 2, len(model.steps) - 1)
                own[1:-1] = model.own[found]
                logs = model.steps[own[:-1], own[1:]].sum() - model.denominators[own[1:-1]].sum()
                for column, value in zip(columns, (len(found) + 1, len(head), float(model.logs[head].sum()), float(logs))):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns, kinds)], ["row", "doc_id", "held_out", "n_tokens", "n_head", "head_logs", "class_logs"])

    return run


def class_bigram_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams) and score (the model), both log10, and perplexity of every document; rows whose id's crc32 modulo `modulus` is 0 are held out."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.held_out(F.col(id_col), modulus).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    train = given.where("not held_out").select("text")
    counts = common.saved(word_counts(train), "word-counts")
    ends = train.count()
    size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    tokens, types = size["tokens"] + ends, size["types"] + (ends > 0)
    known = vocabulary(counts, tokens)
    coded = coded_texts(given, known[1])
    model = learned(coded.where("not held_out").select("symbols"), counts, tokens, known)
    context = docs.sparkSession.sparkContext
    sizes = counts.mapInArrow(_class_sizes(context.broadcast(model)), "class int, tokens long, types long").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).collect()
    for r in sizes:
        model.denominators[r["class"]] = math.log10(r["tokens"] + ADDED * (r["types"] + 1))
    if not sizes:
        model.denominators[:] = math.log10(ADDED)
    scored = common.saved(coded.drop("rare").mapInArrow(_score(context.broadcast(model)), "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_logs double, class_logs double"), "scored")
    # one row for each text and word outside the vocabulary; both sides are dealt for this join alone, so a word in very many texts can be split
    rare = coded.select("row", F.explode("rare").alias("_w")).select("row", F.col("_w.word").cast("string").alias("word"), F.col("_w.n").alias("times"))
    seen = F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0)))
    looked_up = rare.join(counts, "word", "left").groupBy("row").agg(seen.alias("n_rare"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))).alias("rare_logs"))
    joined = scored.join(looked_up, "row", "left")
    logs = F.col("head_logs") + F.coalesce("rare_logs", F.lit(0.0))
    base = logs + F.lit(math.log10(ends + ADDED)) - F.col("n_tokens") * F.lit(math.log10(tokens + ADDED * (types + 1)))
    score = logs + F.col("class_logs")
    n_known = F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(ends > 0))
    return joined.select("doc_id", "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))

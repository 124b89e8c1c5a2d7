"""Token counts that follow edits: a kept tree of pre-tokens for each document.

A text's pre-tokens lie in leaves of bounded size, with their lengths and token counts; inner nodes of
a balanced tree hold sums. build_trees() makes a table of them, which can be written and read again;
apply_edits() brings such a table up to date. An edit finds its leaves by descending the sums of
lengths, and cuts anew only from a few pre-tokens before it (a pre-token's end depends on at most that
much of what follows) to the first border after it that stands as before: from there on, everything
is cut as it was. Only those pre-tokens are encoded; leaves that grow too large are split, and only the
sums above them change.

Counts are those of the tokenizers library, special tokens included.

Nulls, ties and repeats: a null text is empty and has no tokens before its edits; edits are clamped
to the text, and one without a place, or with a null text, changes nothing, puts nothing in; edits
of an id go to every row of that id, in order of their numbers, of equals by place and text; edits
of null or unknown ids are ignored; repeated rows each get the same counts; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Pre-tokens whose counts a Python worker remembers, besides those of one batch.
MEMO = 600_000
#: Pre-tokens of a leaf at most; pre-tokens before an edit that are cut anew, beside those that a special token could reach.
LEAF, BACK = 64, 3
#: Fixed value: the byte-level pre-tokenizer's pattern, with white space as Unicode has it.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

Edit = tuple[int, int, str]


class Counter:
    """Pre-tokens of texts and token counts of pre-tokens, by the library. Special tokens are cut out first, as the library does."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = sorted((x.content for x in self.tokenizer.get_added_tokens_decoder().values()), key=lambda x: (-len(x), x))
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.reach = max(map(len, self.specials), default=1)
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text, which together are the text."""
        if not any(s in text for s in self.specials):
            return PATTERN.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += PATTERN.findall(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + PATTERN.findall(text[at:])

    def counts(self, tokens: list[str]) -> np.ndarray:
        """Numbers of ids of pre-tokens; those not yet known are counted in one call."""
        found = list(map(self.known.get, tokens))
        if None in found:
            new = list({t for t, n in zip(tokens, found) if n is None})
            self.known.update(zip(new, [len(x) for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]))
            found = list(map(self.known.get, tokens))
        return np.array(found, np.int32)


def sizes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(len, tokens), np.int32, len(tokens))


class Leaf:
    """Some pre-tokens in order, with their lengths and counts."""

    __slots__ = ("text", "lengths", "counts", "chars", "tokens", "height")

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, tokens: int):
        self.text, self.lengths, self.counts = text, lengths, counts
        self.chars, self.tokens, self.height = len(text), tokens, 0


class Node:
    """Two subtrees and the sums of their characters and tokens."""

    __slots__ = ("left", "right", "chars", "tokens", "height")

    def __init__(self, left: Tree, right: Tree):
        self.left, self.right = left, right
        self.chars, self.tokens = left.chars + right.chars, left.tokens + right.tokens
        self.height = 1 + max(left.height, right.height)


Tree = Leaf | Node


def joined(a: Tree | None, b: Tree | None) -> Tree | None:
    """Two trees one after the other, as a balanced one: sums change along one path only."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        return _balanced(a.left, joined(a.right, b))
    if b.height > a.height + 1:
        return _balanced(joined(a, b.left), b.right)
    return Node(a, b)


def _balanced(a: Tree, b: Tree) -> Node:
    """A node of two trees whose heights differ by two at most, turned where needed."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return Node(a.left, Node(a.right, b))
        return Node(Node(a.left, a.right.left), Node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return Node(Node(a, b.left), b.right)
        return Node(Node(a, b.left.left), Node(b.left.right, b.right))
    return Node(a, b)


def of_leaves(leaves: list[Leaf]) -> Tree | None:
    """A balanced tree of leaves in order."""
    row: list[Tree] = list(leaves)
    while len(row) > 1:
        row = [Node(row[k], row[k + 1]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
    return row[0] if row else None


def split(tree: Tree | None, place: int) -> tuple[Tree | None, Tree | None]:
    """The leaves that end at a character or before it, and the others."""
    if tree is None or place <= 0:
        return None, tree
    if tree.chars <= place:
        return tree, None
    if tree.height == 0:
        return None, tree
    if place < tree.left.chars:
        a, b = split(tree.left, place)
        return a, joined(b, tree.right)
    a, b = split(tree.right, place - tree.left.chars)
    return joined(tree.left, a), b


def _pop(tree: Tree, last: bool) -> tuple[Leaf, Tree | None]:
    """The last leaf, or the first, and the rest."""
    if tree.height == 0:
        return tree, None
    if last:
        leaf, rest = _pop(tree.right, True)
        return leaf, joined(tree.left, rest)
    leaf, rest = _pop(tree.left, False)
    return leaf, joined(rest, tree.right)


def leaves(tree: Tree | None) -> Iterator[Leaf]:
    todo = [tree] if tree is not None else []
    while todo:
        node = todo.pop()
        if node.height == 0:
            yield node
        else:
            todo += [node.right, node.left]


def cut_leaves(text: str, lengths: np.ndarray, counts: np.ndarray) -> list[Leaf]:
    """Leaves of at most LEAF pre-tokens, of about the same size."""
    n = -(-len(lengths) // LEAF)
    if n < 2:
        return [Leaf(text, lengths, counts, int(counts.sum()))] if n else []
    cuts = np.arange(n + 1) * len(lengths) // n
    chars = np.concatenate([[0], np.cumsum(np.add.reduceat(lengths, cuts[:-1], dtype=np.int64))]).tolist()
    tokens, cuts = np.add.reduceat(counts, cuts[:-1], dtype=np.int64).tolist(), cuts.tolist()
    return [Leaf(text[chars[k] : chars[k + 1]], lengths[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]], tokens[k]) for k in range(n)]


class CountTree:
    """The tree of one text."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray):
        self.tree = of_leaves(cut_leaves(text, lengths, counts))

    @classmethod
    def of(cls, text: str, counter: Counter) -> CountTree:
        tokens = counter.cut(text)
        return cls(text, sizes(tokens), counter.counts(tokens))

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens if self.tree else 0

    @property
    def n_chars(self) -> int:
        return self.tree.chars if self.tree else 0

    def stored(self) -> tuple[str, np.ndarray, np.ndarray]:
        """Text, lengths and counts of the pre-tokens."""
        found = list(leaves(self.tree))
        none = [np.zeros(0, np.int32)]
        return "".join(x.text for x in found), np.concatenate([x.lengths for x in found] or none), np.concatenate([x.counts for x in found] or none)

    def edit(self, start: int, end: int, new: str, counter: Counter) -> int:
        """Replace the characters from start to end by others; returns how many pre-tokens were encoded."""
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        before, rest = split(self.tree, start - 1)
        at = before.chars if before else 0
        held: list[Leaf] = []
        # pre-tokens before the edit: as many as its change may reach
        reach, back = start - 1 - counter.reach, 0
        while before is not None and (at > reach or back < BACK):
            leaf, before = _pop(before, True)
            at -= leaf.chars
            held.insert(0, leaf)
            back += len(leaf.lengths) if at <= reach else 0
        stand, ahead = at + sum(x.chars for x in held), LEAF
        while True:
            # pre-tokens after it: up to its end and some more
            taken = 0
            while rest is not None and (stand < end or taken < ahead):
                leaf, rest = _pop(rest, False)
                taken += len(leaf.lengths) if stand >= end else 0
                stand += leaf.chars
                held.append(leaf)
            text = "".join([x.text for x in held])
            lengths, counts = (np.concatenate([np.zeros(0, np.int32), *c]) for c in ([x.lengths for x in held], [x.counts for x in held]))
            borders = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) + at
            first = max(0, int(np.searchsorted(borders, min(reach, start), "right")) - 1 - BACK)
            base = int(borders[first]) - at
            region = text[base : start - at] + new + text[end - at :]
            shift = len(new) - (end - start)
            behind = int(np.searchsorted(borders, end))
            old = {b: k for k, b in enumerate((borders[behind:] - at - base + shift).tolist(), behind)}
            sure = len(region) if rest is None else len(region) - counter.reach - 4
            tokens, place, stop = [], 0, None
            if 0 in old:
                stop = old[0]
            else:
                for t in counter.cut(region):
                    tokens.append(t)
                    place += len(t)
                    if place in old and place <= sure:
                        stop = old[place]
                        break
            if stop is not None:
                break
            ahead *= 4
        edited = text[: start - at] + new + text[end - at :]
        lengths = np.concatenate([lengths[:first], sizes(tokens), lengths[stop:]])
        counts = np.concatenate([counts[:first], counter.counts(tokens), counts[stop:]])
        if rest is not None and len(lengths) < LEAF // 4:  # so that small leaves don't pile up
            leaf, rest = _pop(rest, False)
            edited, lengths, counts = edited + leaf.text, np.append(lengths, leaf.lengths), np.append(counts, leaf.counts)
        self.tree = joined(joined(before, of_leaves(cut_leaves(edited, lengths, counts))), rest)
        return len(tokens)


#: One counter for each vocabulary in a Python worker, which runs many tasks.
_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    common.remembering("counts", _COUNTERS.clear)
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    if len(_COUNTERS[path].known) > MEMO:
        _COUNTERS[path].known.clear()
    return _COUNTERS[path]


#: What a row of a tree table holds beside its id: the text, and the lengths and counts of its pre-tokens in order, from which leaves and sums are put together without cutting or encoding.
TREES = "doc_id long, text string, lengths array<int>, counts array<int>"


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with common.uncollected():
                counter, texts = _counter(path), common.text_of(batch.column(1))
                cut = [counter.cut(x) for x in texts]
                ends = np.concatenate([[0], np.cumsum(sizes(cut), dtype=np.int64)])
                flat = list(chain.from_iterable(cut))
                lengths, counts = sizes(flat), counter.counts(flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), _lists(ends, lengths), _lists(ends, counts)], ["doc_id", "text", "lengths", "counts"])

    return run


def build_trees(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A tree for each document (TREES), to be kept. path: the tokenizer."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_build(path), TREES)


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column; null as empty."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return [values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def _edited(path: str, kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with common.uncollected():
                counter, numbers, trees = _counter(path), [], []
                for text, lengths, counts, edits in zip(common.text_of(batch.column(1)), _rows(batch.column(2)), _rows(batch.column(3)), batch.column(4).to_pylist()):
                    tree = CountTree(text, lengths, counts)
                    old = (len(lengths), tree.n_tokens)
                    again = sum(tree.edit(e["start"], e["end"], e["text"], counter) for e in edits or ())
                    numbers.append((*old, tree.n_chars, tree.n_tokens, again))
                    if kept:
                        trees.append(tree.stored())
            columns, names = [batch.column(0)], ["doc_id"]
            if kept:
                ends = np.concatenate([[0], np.cumsum([len(x) for _, x, _ in trees], dtype=np.int64)])
                none = np.zeros(0, np.int32)
                columns += [pa.array([x for x, _, _ in trees], pa.string()), *[_lists(ends, np.concatenate([none, *(t[k] for t in trees)])) for k in (1, 2)]]
                names += ["text", "lengths", "counts"]
            columns += [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * len(NUMBERS)
            yield pa.RecordBatch.from_arrays(columns, [*names, *NUMBERS])

    return run


NUMBERS = ("n_pretokens", "n_tokens", "edited_chars", "edited_tokens", "n_reencoded")
EDITS = "array<struct<start: bigint, end: bigint, text: string>>"


def with_edits(trees: DataFrame, edits: Column, path: str, kept: bool = True) -> DataFrame:
    """The trees after the edits of a column (EDITS) of theirs, or, where they aren't kept, doc_id alone, with n_pretokens and n_tokens before them, edited_chars and edited_tokens after them, and n_reencoded, the pre-tokens encoded for them. A row is edited where it lies."""
    given = F.filter(edits, lambda e: e["start"].isNotNull() & e["end"].isNotNull())
    own = F.transform(given, lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), F.coalesce(e["text"], F.lit("")).alias("text")))
    return trees.select("doc_id", "text", "lengths", "counts", own.cast(EDITS).alias("edits")).mapInArrow(_edited(path, kept), (TREES if kept else "doc_id long") + "".join(f", {n} long" for n in NUMBERS))


def apply_edits(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The same from a table of edits (doc_id, seq, start, end, text). Only trees that are edited meet the edits in a join; a document's edits follow one another, so they come as one list."""
    order = F.struct("seq", "start", "end", "text")
    lists = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(order)).alias("edits"))
    lists = common.saved(lists.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["text"].alias("text")))), "edits")
    touched = common.may_be_in(lists.select("doc_id"), F.col("doc_id"))
    met = trees.where(touched).join(lists, "doc_id", "left").unionByName(trees.where(~touched).withColumn("edits", F.lit(None).cast(EDITS)))
    return with_edits(met, F.col("edits"), path)


def sample_edits(text: Column) -> Column:
    """The edits that the registered query applies to every text, one after the other: a mark in the middle, the first 20 characters away, another end."""
    n = F.length(text).cast("long")
    marked = n + 9
    one = lambda start, end, new: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(new).alias("text"))
    return F.array(one(F.floor(n / 2), F.floor(n / 2), " [edited]"), one(F.lit(0), F.lit(20), ""), one(F.greatest(F.lit(0), marked - F.least(F.lit(20), marked) - 10), F.lit(1 << 60), "\n\nend 123"))


def edit_counts(docs: DataFrame, path: str, edits: Callable[[Column], Column] = sample_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build and keep the trees of all documents, apply to them the edits that a function of the text gives, and return doc_id and the numbers of with_edits."""
    trees = common.saved(build_trees(docs, path, id_col, text_col), "count-trees")
    return with_edits(trees, edits(F.coalesce(F.col("text"), F.lit(""))), path, kept=False)

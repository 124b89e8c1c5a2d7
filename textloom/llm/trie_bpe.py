"""BPE encoding and decoding by a depth-first walk of a trie of distinct words.

An encoding is right exactly if each two neighbours in it are: their joined text encodes to the
two themselves. So a prefix has one last token, the one that may follow the last token of what
stands before it. Distinct words in sorted order are their trie's depth-first order; a stack holds
the last token of every prefix on the current path, and what words share is encoded once.

The vocabulary is a JSON file of the tokenizers library with lower-casing, NFC, a split at white
space that is dropped, and word ends marked by a suffix; ids and decoded texts equal the library's.

Nulls, ties and repeats: a null text is empty and has no ids; a null id stays null; repeated rows
each get the same result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Entries that a task remembers at most, of each kind.
MEMO = 400_000
#: Fixed value: white space as Unicode has it; Python's split() also cuts at the four control characters below.
WHITE_SPACE = re.compile("[\t-\r \u0085   -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(x) if x in plain else chr(next(spare)) for x in range(256)]


class TrieBPE:
    """A vocabulary with what is known of its tokens' neighbourhoods, and encodings of recent words."""

    def __init__(self, config: dict):
        model = config["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.names = [""] * (max([*self.ids.values(), *(x["id"] for x in config.get("added_tokens", []))], default=-1) + 1)
        for token, i in self.ids.items():
            self.names[i] = token
        self.ranks = {tuple(pair if isinstance(pair, list) else pair.split(" ")): k for k, pair in enumerate(model["merges"])}
        self.specials = {x["content"]: x["id"] for x in config.get("added_tokens", [])}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        splits = [x for x in config["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.bytes = str.maketrans(dict(enumerate(byte_characters())))
        self.sizes = [len(t.removesuffix(self.end)) for t in self.names]
        self.inner, self.final = self._token_lengths()
        self._alone: dict[str, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, tuple[bytes, str]] = {}
        self._pieces: dict[str, tuple[bytes, str]] = {}

    def _token_lengths(self) -> tuple[dict[str, tuple[int, ...]], dict[str, tuple[int, ...]]]:
        """By the last two characters of tokens inside words, and of tokens that end them: which lengths occur, falling. 1 always does."""
        inner, final = {}, {}
        for token in self.ids:
            body = token.removesuffix(self.end)
            if len(body) > 1:
                (final if len(body) < len(token) else inner).setdefault(body[-2:], {1}).add(len(body))
        return tuple({k: tuple(sorted(v, reverse=True)) for k, v in found.items()} for found in (inner, final))

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        return [*body[:-1], body[-1] + self.end] if token.endswith(self.end) and body else list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """Merge the neighbours of lowest rank, the leftmost of equals, until none has a rank. Only for tokens and pairs of them."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _starts(self, token: str) -> bool:
        """Whether the token may begin a word: whether its text encodes to it."""
        found = self._alone.get(token)
        if found is None:
            found = self._alone[token] = self._merged(self._symbols(token)) == [token]
        return found

    def _follows(self, before: int, token: str, pair: int) -> bool:
        """Whether the token may stand after another: whether their joined text encodes to the two. pair: their number among all pairs."""
        if len(self._pairs) > 4 * MEMO:
            self._pairs.clear()
        name = self.names[before]
        found = self._pairs[pair] = self._merged(self._symbols(name) + self._symbols(token)) == [name, token]
        return found

    def _last(self, word: str, stop: int, states: list[int], lengths: dict[str, tuple[int, ...]], suffix: str) -> int:
        """The last token of word[:stop], the longest that may follow; states: last tokens of shorter prefixes."""
        ids, pairs = self.ids, self._pairs
        for size in lengths.get(word[stop - 2 : stop], (1,)) if stop > 1 else (1,):
            start = stop - size
            if start < 0:
                continue
            token = word[start:stop] + suffix
            own = ids.get(token)
            if own is None:
                continue
            if not start:
                if self._starts(token):
                    return own
                continue
            pair = states[start] << 24 | own
            found = pairs.get(pair)
            if found is None:
                found = self._follows(states[start], token, pair)
            if found:
                return own
        raise ValueError(f"no encoding of {word[:stop]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, given as characters that stand for bytes."""
        found: dict[str, list[int]] = {}
        last, states, sizes, inner, final, end, step = "", [-1], self.sizes, self.inner, self.final, self.end, self._last
        for word in sorted(words):
            size = len(word)
            same, most = 0, min(len(states) - 1, size)
            while same < most and last[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for stop in range(same + 1, size):
                states.append(step(word, stop, states, inner, ""))
            own = step(word, size, states, final, end)
            ids, at = [own], size - sizes[own]
            while at:
                own = states[at]
                ids.append(own)
                at -= sizes[own]
            ids.reverse()
            found[word] = ids
            last = word
        return found

    def _split(self, piece: str) -> list[tuple[str, bool]]:
        """Words of a piece without white space, in characters that stand for bytes; specials are marked."""
        if piece.isascii() and piece.isalpha():
            return [(piece.lower(), False)]
        out = []
        for k, part in enumerate(self.special.split(piece) if self.special and "<" in piece else [piece]):
            if k % 2:
                out.append((part, True))
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3")  # the capital sigma's lower case depends on what follows; the library's doesn't
                for word in self.pattern.findall(part.lower()):
                    out.append((word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.bytes), False))
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids and tokens of pieces; new words go through the trie together."""
        if len(self._words) > MEMO:
            self._words.clear()
        words, names = self._words, self.names
        split = {p: self._split(p) for p in pieces}
        for word, ids in self.encode_words({w for parts in split.values() for w, special in parts if not special and w not in words}).items():
            words[word] = struct.pack(f"<{len(ids)}I", *ids), " ".join([names[i] for i in ids])
        known = self._pieces
        for piece, parts in split.items():
            if len(parts) == 1 and not parts[0][1]:
                known[piece] = words[parts[0][0]]
            else:
                rows = [(struct.pack("<I", self.specials[w]), w) if special else words[w] for w, special in parts]
                known[piece] = b"".join([r[0] for r in rows]), " ".join([r[1] for r in rows])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text, of each text. What is new in all of them is learned first."""
        if len(self._pieces) > MEMO:
            self._pieces.clear()
        cut = [[p for p in WHITE_SPACE.split(text) if p] if SEPARATORS.search(text) else text.split() for text in texts]
        known = self._pieces
        self.learn({p for pieces in cut for p in pieces if p not in known})
        for pieces in cut:
            rows = [known[p] for p in pieces]
            yield b"".join([r[0] for r in rows]), " ".join([r[1] for r in rows if r[0]])


def load(path: str) -> TrieBPE:
    """Read a vocabulary on the driver; it goes to the tasks with the code."""
    with open(path, encoding="utf-8") as f:
        return TrieBPE(json.load(f))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, and decoded, the tokens joined by spaces as the library decodes them."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with common.uncollected():
                rows = list(shared.value.encode(common.text_of(batch.column(1))))
            ids, decoded = [r[0] for r in rows], [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")

"""Toxicity: a weighted finite-state grammar over the clauses of a text.

A lexical transducer reads characters and finds the words that carry weight: insults, by seeds with
the usual endings and by stems learned from labelled rows, and verbs of violence. Each clause that
holds such a word goes, as a sequence of word kinds, through five transducers, which are tables of
states and arcs with outputs and weights: threat joins a verb of violence and the one it is aimed at;
negation marks what it has in its scope, to the clause's end or a contrast; reported speech marks what
follows its verb, past a colon, and what quotation marks after it enclose, to the closing one even over several sentences of a line;
target marks insults of someone addressed or spoken of, and notes one who is named right after an insult; insult writes the tag of each mark.
compose() makes one transducer of them: along a path weights multiply, and what several payloads of a
clause give under a tag adds up. The sums by tag give the score through a logistic function: every
arc that writes a tag has a coefficient of its own, fitted to labelled rows, starting from fixed ones.

Nulls, ties and repeats: a null or empty text has no clause and gets the score of a text in which
nothing matches; without labelled rows the fixed seeds and coefficients are used; a null id
changes nothing; a label row without id or label is ignored, and an id labelled twice counts as
toxic if one of its labels says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows of either label that are learned from, at most about.
POSITIVES, NEGATIVES = 6000, 12000
#: Lengths of stems in characters, what may follow a learned stem in its word at most; learned stems at most; documents that a stem must be found in.
STEM_LENGTHS, ENDING, STEMS, SUPPORT = (4, 5, 6, 7, 8, 9, 10), 8, 400, 5
#: A stem must be this many times likelier in toxic documents; candidates sent to the driver at most.
LIFT, CANDIDATES = 12.0, 40000
SAMPLE_PARTITIONS = 32

#: Seeds of the lexicon, what may follow them, and the words that the grammar tells apart.
INSULTS = "idiot moron scum loser trash stupid worthless pathetic disgusting clown imbecile dumbass bastard idiota imbecil estúpido estúpida idiote crétin connard abruti dummkopf arschloch vollidiot trottel".split()
ENDINGS = frozenset(["", "s", "es", "'s", "e", "n", "en", "er", "ly", "ic", "ish"])
VIOLENCE = "kill hurt beat destroy murder strangle umbringen schlagen töten matar golpear tuer frapper".split()
VIOLENT_ENDINGS = frozenset(["", "s", "ing", "ed"])
TARGETS = frozenset("you your you're u he she they him them these those dich euch du ihr sie tu toi te vous tú usted ustedes".split())
OBJECTS = frozenset("dich euch te vous".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't won't wouldn't don't doesn't didn't can't cannot nicht kein keine nie pas jamais nunca".split())
REPORTS = frozenset("said says say wrote writes claimed called quoted sagte sagt schrieb dit écrit dijo dice".split())
CONTRASTS = frozenset("but aber sondern mais pero sino".split())

TAGS = ("plain", "targeted", "negated", "reported", "threat", "negated threat", "reported threat", "reported negated", "reported negated threat")
#: Coefficients before fitting; the first is the constant.
START = np.array([-3.5, 4.0, 5.0, 3.0, 3.0, 6.0, 1.0, 2.0, 1.5, 1.0])
CLAUSE_END = re.compile(r"[.!?;\n。！？；…।؟۔]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
#: Quotation marks, and what the transducers read: words, quotation marks, colons, other ends of clauses.
QUOTE = re.compile(r'["“”„‟«»‹›「」]')
SYMBOL = re.compile(rf"{WORD.pattern}|{QUOTE.pattern}|[.!?;:\n。！？；：…।؟۔]")

#: Kinds of what the transducers read: other word, target, object before its verb, negation, report, contrast, insult, violence, quotation mark, colon, another clause's end.
KINDS = "w t o n r c i v q k e".split()


class Transducer:
    """States from 0, arcs[state][input] = (next state, output, weight). Input that a state has no arc for is copied, and the state stays. Output "" is none."""

    def __init__(self, arcs: list[dict[str, tuple[int, str, float]]]):
        self.arcs = arcs

    def arc(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs[state].get(symbol, (state, symbol, 1.0)) if symbol else (state, "", 1.0)

    def read(self, symbols: list[str]) -> list[tuple[str, float]]:
        """Outputs with the weights of their arcs."""
        state, out = 0, []
        for x in symbols:
            state, y, weight = self.arc(state, x)
            if y:
                out.append((y, weight))
        return out


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """The transducer that gives what the second makes of the first one's output. States are the pairs that can be reached; weights multiply."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
    while todo:
        a, b = todo.pop(0)
        own = {}
        for x in alphabet:
            next_a, y, weight = first.arc(a, x)
            next_b, z, more = second.arc(b, y)
            if (next_a, next_b) not in number:
                number[next_a, next_b] = len(number)
                todo.append((next_a, next_b))
            own[x] = (number[next_a, next_b], z, weight * more)
        arcs.append(own)
    return Transducer(arcs)


#: A clause ends within what is read: where it began, but for a quotation, which lasts.
_ENDS = {"k": (0, "k", 1.0), "e": (0, "e", 1.0)}
#: Threat: a verb of violence and a target within two words after it, or an object and the verb within three; H stands for both.
_OPEN = {"v": (1, "w", 1.0), "o": (3, "t", 1.0)}
THREAT = Transducer(
    [
        _OPEN,
        _OPEN | _ENDS | {x: (0, "H", 1.0) for x in "to"} | {x: (2, x, 1.0) for x in "wnrci"},
        _OPEN | _ENDS | {x: (0, "H", 1.0) for x in "to"} | {x: (0, x, 1.0) for x in "wnrci"},
        *[_OPEN | _ENDS | {"v": (0, "H", 1.0), "o": (3, "t", 1.0)} | {x: (after, x, 1.0) for x in "wtnrci"} for after in (4, 5, 0)],
    ]
)
#: Negation: what follows it is marked -, up to a contrast.
NEGATION = Transducer([{"n": (1, "w", 1.0), "c": (0, "w", 1.0)}, _ENDS | {"n": (1, "w", 1.0), "c": (0, "w", 1.0), "i": (1, "i-", 1.0), "H": (1, "H-", 1.0)}])
#: Reported speech: what follows a report, past a colon, is marked with a quote; quotation marks after it close the scope with the second of them, and no end of a clause does.
_SAID = {x: x + '"' for x in ("i", "i-", "H", "H-")}
REPORT = Transducer(
    [
        {"r": (1, "w", 1.0)},
        {"r": (1, "w", 1.0), "q": (2, "q", 1.0), "e": (0, "e", 1.0)} | {x: (1, y, 1.0) for x, y in _SAID.items()},
        {"r": (2, "w", 1.0), "q": (0, "q", 1.0)} | {x: (2, y, 1.0) for x, y in _SAID.items()},
    ]
)
#: Target: an insult after someone was named is marked !; who is named right after an insult makes t!.
_NAMED = {x: (1, x, 1.0) for x in ("t", "H", "H-", 'H"', 'H-"')}
TARGET = Transducer([_NAMED | {"i": (2, "i", 1.0)}, _ENDS | {"i": (1, "i!", 1.0)}, _NAMED | _ENDS | {"t": (1, "t!", 1.0), "i": (2, "i", 1.0)} | {x: (0, x, 1.0) for x in ("w", "q", "i-", 'i"', 'i-"')}])
#: Insult: the tags; other words and signs give nothing.
INSULT = Transducer([{x: (0, "", 1.0) for x in "wtqke"} | {"i": (0, "plain", 1.0), "i!": (0, "targeted", 1.0), "t!": (0, "targeted", 1.0), "i-": (0, "negated", 1.0), 'i"': (0, "reported", 1.0), 'i-"': (0, "reported negated", 1.0), "H": (0, "threat", 1.0), "H-": (0, "negated threat", 1.0), 'H"': (0, "reported threat", 1.0), 'H-"': (0, "reported negated threat", 1.0)}])

CLAUSE = THREAT
for _next in (NEGATION, REPORT, TARGET, INSULT):
    CLAUSE = compose(CLAUSE, _next, KINDS)


class Grammar:
    """The lexicon with its weights, the composed transducer of clauses, and the coefficients of its tags."""

    def __init__(self, stems: dict[str, float], coefficients: np.ndarray = START):
        self.stems, self.coefficients = dict(stems), np.array(coefficients, float)
        self._automaton = None

    def __getstate__(self) -> tuple:
        return self.stems, self.coefficients

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _payloads(self, text: str) -> dict[int, tuple[str, float]]:
        """Words that are insults or verbs of violence, by their place: kind and weight, of the longest entry that the word begins with and whose endings allow the rest."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            lexicon = {v: ("v", 1.0, VIOLENT_ENDINGS) for v in VIOLENCE} | {s: ("i", w, None) for s, w in self.stems.items()} | {s: ("i", self.stems.get(s, 1.0), ENDINGS) for s in INSULTS}
            for entry, (kind, weight, endings) in lexicon.items():
                self._automaton.add_word(entry, (len(entry), kind, weight, endings))
            self._automaton.make_automaton()
        found: dict[int, tuple[int, str, float]] = {}
        for end, (length, kind, weight, endings) in self._automaton.iter(text):
            start = end - length + 1
            if (start and text[start - 1].isalnum()) or found.get(start, (0,))[0] >= length:
                continue
            rest = WORD.match(text, start).group()[length:].replace("’", "'")
            if rest in endings if endings is not None else len(rest) <= ENDING:
                found[start] = (length, kind, weight)
        return {start: (kind, weight) for start, (_, kind, weight) in sorted(found.items())}

    def features(self, text: str) -> np.ndarray:
        """Sums of weights by tag over all clauses with a payload, dampened by a logarithm."""
        sums = dict.fromkeys(TAGS, 0.0)
        text = text.lower()
        payloads = self._payloads(text)
        end = line = -1
        for at in payloads:
            if at >= line:
                first, line = _line_bounds(text, at)
                quoted = QUOTE.search(text, first, line) is not None
            if at >= end:
                start, end = (first, line) if quoted else _clause_bounds(text, at)
                for tag, weight in read_clause(text, start, end, payloads):
                    sums[tag] += weight
        return np.log1p(np.array([sums[t] for t in TAGS]))

    def score(self, features: np.ndarray) -> np.ndarray:
        """From 0 to 1."""
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + features @ self.coefficients[1:], -30, 30)))


def kind_of(word: str) -> str:
    """The kind of a word that is no payload, or of a sign."""
    if not word[0].isalnum():
        return "k" if word in ":：" else "q" if QUOTE.match(word) else "e"
    word = word.replace("’", "'")
    for kind, words in (("o", OBJECTS), ("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS), ("c", CONTRASTS)):
        if word in words:
            return kind
    return "w"


def read_clause(text: str, start: int, end: int, payloads: dict[int, tuple[str, float]]) -> Iterator[tuple[str, float]]:
    """Tags and weights that the composed transducer gives for a clause, or a line with quotation marks. An insult's own weight goes along with its output, and with that of a target right after it; a threat's is 1."""
    state, insult = 0, 1.0
    for found in SYMBOL.finditer(text, start, end):
        kind, own = payloads.get(found.start()) or (kind_of(found.group()), insult)
        if kind == "i":
            insult = own
        state, tag, weight = CLAUSE.arc(state, kind)
        if tag:
            yield tag, weight * (1.0 if tag.endswith("threat") else own)


def _clause_bounds(text: str, at: int) -> tuple[int, int]:
    """The clause around a place, with all before it that colons join to it: from after the last sign but a colon that ends a clause to the next such sign."""
    start = max(text.rfind(sign, 0, at) for sign in ".!?;\n。！？；…।؟۔") + 1
    found = CLAUSE_END.search(text, at)
    return start, found.start() if found else len(text)


def _line_bounds(text: str, at: int) -> tuple[int, int]:
    end = text.find("\n", at)
    return text.rfind("\n", 0, at) + 1, len(text) if end < 0 else end


def _stems(text: str) -> set[str]:
    """The stems that words of a text begin with and that leave an ending."""
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in STEM_LENGTHS if n <= len(w) <= n + ENDING and w[0].isalpha()}


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = (Counter(), Counter())
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), common.text_of(batch.column(1))):
            found[label].update(_stems(text))
    keys = [k for k in found[1]]
    rest = [k for k in found[0] if k not in found[1]]
    for some in (keys, rest):
        for at in range(0, len(some), 50_000):
            part = some[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([found[1][k] for k in part], pa.int64()), pa.array([found[0][k] for k in part], pa.int64())], ["stem", "toxic", "clean"])


def _candidates(sample: DataFrame, toxic: int, clean: int) -> list[tuple[str, int, int]]:
    """Stems far likelier in toxic texts of the sample than in clean ones, the best CANDIDATES of them."""
    counted = sample.select("toxic", "text").mapInArrow(_count_stems, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") / F.lit(max(toxic, 1))) / ((F.col("clean") + 0.5) / F.lit(max(clean, 1)))
    return [tuple(r) for r in counted.where((F.col("toxic") >= SUPPORT) & (lift >= LIFT)).orderBy(F.desc("toxic"), "stem").limit(CANDIDATES).collect()]


def _documents_with(stems: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_pylist()
            own = [sorted(_stems(text) & stems) for text in common.text_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(own, pa.list_(pa.string()))], ["toxic", "stems"])

    return run


def cover(rows: list[tuple[int, list[str]]], penalties: tuple[float, ...] = (2.0,), most: int = STEMS, support: int = SUPPORT) -> dict[str, float]:
    """Stems that explain the toxic rows: each takes the most rows that no earlier stem explains, less the penalty for each clean row it hits; of equals the longer. The penalties follow one another, from strict to lax. Rows must be distinct texts."""
    holds: dict[str, set[int]] = defaultdict(set)
    clean: Counter = Counter()
    for k, (toxic, stems) in enumerate(rows):
        for s in stems:
            if toxic:
                holds[s].add(k)
            else:
                clean[s] += 1
    chosen: dict[str, float] = {}
    for penalty in penalties:
        while len(chosen) < most and holds:
            best = max(holds, key=lambda s: (len(holds[s]) - penalty * clean[s], len(s), s))
            gain = holds[best]
            if len(gain) - penalty * clean[best] < support:
                break
            chosen[best] = max(0.05, math.log((len(gain) + 0.5) / (clean[best] + 0.5)) / 4)
            holds = {s: left for s, own in holds.items() if len(left := own - gain) >= support}
    return chosen


def fit_coefficients(features: np.ndarray, toxic: np.ndarray, start: np.ndarray = START, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's steps, drawn to the fixed coefficients."""
    if not len(features):
        return start
    x = np.hstack([np.ones((len(features), 1)), features])
    beta = start.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (p - toxic) + strength * (beta - start)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(beta)), gradient)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts with labels that may be learned from: rows whose id's crc32 modulo 5 isn't 0."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~common.held_out(F.col("doc_id"), 5))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    parts = [common.hash_fraction(known.where(F.col("toxic") == label), most, seen.get(label, 0)) for label, most in ((1, POSITIVES), (0, NEGATIVES))]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # at most about POSITIVES + NEGATIVES ids, so the texts of other rows needn't be shuffled
    return texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Learn stems, their weights and the coefficients from at most about POSITIVES + NEGATIVES labelled rows; of rows with the same text one is used."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    once = rows.groupBy(F.xxhash64("text").alias("_same")).agg(F.min(F.struct("doc_id", "toxic", "text")).alias("_row")).select("_row.toxic", "_row.text")
    every = common.saved(once, "toxicity-texts")
    sample = common.saved(common.hash_fraction(every, 2 * (POSITIVES + NEGATIVES), every.count()).repartition(SAMPLE_PARTITIONS), "toxicity-sample")  # more texts than ids only where ids repeat
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    candidates = _candidates(sample, seen.get(1, 0), seen.get(0, 0))
    with_stems = sample.select("toxic", "text").mapInArrow(_documents_with({s for s, _, _ in candidates}), "toxic int, stems array<string>").where(F.size("stems") > 0)
    learned = cover([(r["toxic"], r["stems"]) for r in with_stems.toLocalIterator()], (2.0, 4.0 * seen.get(1, 0) / max(seen.get(0, 0), 1))) if candidates else {}
    grammar = Grammar({s: 1.0 for s in INSULTS} | learned)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.features(x).tolist() for x in common.text_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    measured = sample.select("toxic", "text").mapInArrow(measure, "toxic int, features array<double>").groupBy("toxic", "features").count().collect()
    x = np.array([r["features"] for r in measured for _ in range(r["count"])], float).reshape(-1, len(TAGS))
    grammar.coefficients = fit_coefficients(x, np.array([r["toxic"] for r in measured for _ in range(r["count"])], float))
    common.drop(every, sample)
    return grammar


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A score and a prediction for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value
            rows = [own.features(x) for x in common.text_of(batch.column(1))]
            scores = own.score(np.array(rows).reshape(-1, len(TAGS)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that aren't predicted to be toxic."""
    shared, at = docs.sparkSession.sparkContext.broadcast(grammar), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.features(x) for x in common.text_of(batch.column(at))]
            yield batch.filter(pa.array(shared.value.score(np.array(rows).reshape(-1, len(TAGS))) < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit the grammar to labelled rows that aren't held out and score all documents."""
    return score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)

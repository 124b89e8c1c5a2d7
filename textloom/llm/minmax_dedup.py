"""MinHash near-dedup with min-max hashing.

A document's set is its distinct word shingles. Under each of half as many random permutations
as a signature has values, both the smallest and the largest hash are kept; bands of the
signature put documents into buckets. Texts with equal sets form a class at once. A bucket is cut
into chunks of bounded size; classes are compared with the most central one of their chunk, and the
chunks' central ones with that of the bucket. Where that leaves several components in a bucket, its
classes of different components are compared with each other in blocks, by odd sketches: the bits in
which two of them differ are at most the elements in which the sets differ, so no link is lost, and
only pairs that pass are written. Every link is confirmed on the full sets.

Nulls, ties and repeats: each row has a number of its own, so repeated and null ids are no obstacle,
and rows that repeat an id with other texts are judged by their own text; a null or empty text has no
shingles, links with nothing and is kept; component_id is the smallest id of the component's rows,
null if none has one; a row with a null id is kept only if it is the first of such a component; of
each component one row is `first`; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Values of a signature (half as many hash evaluations), and the chance to miss a link at the threshold that bands may have.
VALUES, MISS = 100, 1e-5
#: Shingles hashed under all permutations at once, and words whose hashes a task remembers.
CHUNK, MEMO = 8192, 300_000
#: Bits of an odd sketch: the power of two that a set's size reaches, between these.
LEAST_BITS, MOST_BITS = 1024, 16_384
#: Classes of a bucket that are compared with one central class, about; classes of a block at least, about, and how many times the root of a bucket's size if that is more; classes compared at once.
STAR, BLOCK, ROOTS, TILE = 256, 512, 8, 256

_RNG = np.random.default_rng(20240229)
MULTIPLIERS = _RNG.integers(1 << 62, dtype=np.uint64, size=VALUES // 2) * np.uint64(2) + np.uint64(1)
PLACES = _RNG.integers(1 << 62, dtype=np.uint64, size=64) * np.uint64(2) + np.uint64(1)
_LOCAL = threading.local()


def rows_per_band(similarity: float, values: int = VALUES, miss: float = MISS) -> int:
    """The most rows a band may have so that a link at the threshold is missed with at most the given chance."""
    fit = [r for r in range(1, 11) if (1 - similarity**r) ** (values // r) <= miss]
    return max(fit, default=1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles, in lower case for A-Z; of the whole sequence if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    common.remembering("words", _LOCAL.__dict__.clear)
    memo = _LOCAL.__dict__.setdefault("memo", {})
    if len(memo) > MEMO:
        memo.clear()
    hashes = [memo.get(w) for w in words]
    if None in hashes:
        for k, h in enumerate(hashes):
            if h is None:
                hashes[k] = memo[words[k]] = xxhash.xxh3_64_intdigest(words[k])
    codes = np.array(hashes, np.uint64)
    n = min(width, len(codes))
    total = np.full(len(codes) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total += codes[k : len(codes) - n + 1 + k] * PLACES[k]
    return np.unique(_mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest, then largest hash under every permutation."""
    low = high = None
    for at in range(0, len(found), CHUNK):
        hashed = found[at : at + CHUNK, None] * MULTIPLIERS
        least, most = hashed.min(0), hashed.max(0)
        low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
    return np.concatenate([low, high])


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band; a band's values come from different permutations."""
    bands = len(values) // rows
    keys = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        keys = _mixed(keys * np.uint64(31) + values[k * bands : (k + 1) * bands])
    return keys.view(np.int64)


def odd_sketch(found: np.ndarray) -> bytes:
    """Packed parities of how many of the hashes fall into each cell."""
    bits = LEAST_BITS
    while bits < min(len(found), MOST_BITS):
        bits *= 2
    cells = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Odd sketches of `size` bytes as rows of 64-bit words, from ones of that size or larger ones."""
    out = np.empty((len(sketches), size // 8), np.uint64)
    for k, x in enumerate(sketches):
        words = np.frombuffer(x, np.uint64)
        out[k] = words if len(x) == size else np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0)
    return out


def may_link(na: np.ndarray, nb: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many elements may be similar enough."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _signatures(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, bands, sketches = [], [], [], []
            for text in common.bytes_of(batch.column(2)):
                found = shingles(text, width)
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(signature(found), rows) if len(found) else None)
                sketches.append(odd_sketch(found) if len(found) else None)
            columns = [pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "doc_id", "n_shingles", "same", "bands", "sketch"])

    return run


def _sketched(percent: int):
    """Of pairs with both sketches, those that may be links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = []
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                size = min(len(x), len(y))
                one, other = folded([x, y], size)
                apart.append(int(np.bitwise_count(one ^ other).sum()))
            keep = may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), np.array(apart, np.int64), percent)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1, 6)], ["a", "b", "ca"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, None
        for batch in batches:
            a, b, linked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, x, y in zip(a, common.bytes_of(batch.column(2)), common.bytes_of(batch.column(3))):
                if i != last:
                    last, first = i, shingles(x, width)
                other = shingles(y, width)
                both = len(np.intersect1d(first, other, assume_unique=True))
                linked.append(100 * both >= percent * (len(first) + len(other) - both))
            keep = [k for k, x in enumerate(linked) if x]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64())], ["u", "v"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of row numbers whose full sets are similar enough, as (u, v). texts: row, text."""
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row")))
    ours = common.saved(texts.where(common.may_be_in(wanted, F.col("row"))).select("row", "text"), "dedup-texts")
    joined = pairs.join(ours.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").join(ours.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
    found = common.saved(joined.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "u long, v long"), "dedup-links")
    common.drop(ours)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of the edges (u, v): the smallest node that is reachable, written to the shared folder. Large-star and small-star rounds in turn, each written there too."""
    edges = common.saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.redealt(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = common.redealt(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, common.saved(small, "edges")
        found = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        common.drop(before)
        if tuple(found) == state:
            break
        state = tuple(found)
    labels = common.saved(edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component"), "components")
    common.drop(edges)
    return labels


def _with_components(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _central_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """(a, ca, na, b, nb): each class with the most central one of its chunk, and that with the most central one of the bucket; ca tells how central a is. buckets: key, chunk, rep, n, central."""
    best = F.max(F.struct("central", (-F.col("rep")).alias("minus"), "n")).alias("_p")
    centers = common.saved(buckets.groupBy("key", "chunk").agg(best).select("key", "chunk", F.col("_p.central").alias("central"), (-F.col("_p.minus")).alias("rep"), F.col("_p.n").alias("n")), "centers")
    top = centers.groupBy("key").agg(best, F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key", (-F.col("_p.minus")).alias("a"), F.col("_p.central").alias("ca"), F.col("_p.n").alias("na"))
    stars = [buckets.select("key", "chunk", F.col("rep").alias("b"), F.col("n").alias("nb")).join(centers.select("key", "chunk", F.col("rep").alias("a"), F.col("central").alias("ca"), F.col("n").alias("na")), ["key", "chunk"])]
    stars.append(centers.select("key", F.col("rep").alias("b"), F.col("n").alias("nb")).join(common.redealt(top, "key"), "key"))
    found = [x.where(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "ca", "na", "b", "nb") for x in stars]
    pairs = common.saved(found[0].union(found[1]).distinct(), "star-pairs")
    common.drop(centers)
    return pairs


def _compared(percent: int):
    """Of the classes of each block, those pairs of different components, and between different chunks if the block has two, that may be links."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        rep, component, n, chunk = (rows[c].to_numpy() for c in ("rep", "component", "n", "chunk"))
        order = np.argsort(n, kind="stable")
        rep, component, n, chunk = (x[order] for x in (rep, component, n, chunk))
        sketch = rows["sketch"].to_pylist()
        sketch = [sketch[k] for k in order]
        inner = chunk.min() == chunk.max()
        out: list[list[np.ndarray]] = [[], []]
        for at in range(0, len(n), TILE):
            end = min(at + TILE, len(n))
            stop = int(np.searchsorted(n, 100 * n[end - 1] // percent, "right"))
            size = len(sketch[at])  # sorted by size of set, so none here is smaller
            own, other = folded(sketch[at:end], size), folded(sketch[at:stop], size)
            apart = np.zeros((len(own), len(other)), np.int64)
            for w in range(size // 8):
                apart += np.bitwise_count(own[:, w, None] ^ other[None, :, w])
            ok = may_link(n[at:end, None], n[None, at:stop], apart, percent) & (component[at:end, None] != component[None, at:stop])
            ok &= np.arange(at, end)[:, None] < np.arange(at, stop)[None]
            if not inner:
                ok &= chunk[at:end, None] != chunk[None, at:stop]
            i, j = np.nonzero(ok)
            one, two = rep[at:end][i], rep[at:stop][j]
            out[0].append(np.minimum(one, two)), out[1].append(np.maximum(one, two))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            names = [batch.column(c).to_numpy() for c in ("key", "x", "y")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in names], axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
                if high == low:
                    continue
                block = tuple(c[low] for c in names)
                if block != last and held:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                last = block
                held.append(batch.slice(low, high - low))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def _across(buckets: DataFrame, classes: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """(a, b): pairs of classes that share a bucket, have different components and may be links. A bucket of many such classes is cut into chunks, of which two make a block."""
    rows = common.saved(_with_components(buckets.select("key", "rep", "n"), labels), "labelled-buckets")
    several = rows.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), F.count(F.lit(1)).alias("_size")).where("_low < _high")
    apart = common.saved(rows.join(common.redealt(several.select("key", F.ceil(F.col("_size") / F.greatest(F.lit(float(BLOCK)), ROOTS * F.sqrt("_size"))).cast("int").alias("chunks")), "key"), "key"), "apart")
    common.drop(rows)
    dealt = apart.join(classes.select("rep", "sketch"), "rep").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    blocks = dealt.select("key", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "rep", "component", "n", "sketch")
    found = blocks.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_compared(percent), "a long, b long")
    pairs = common.saved(found.distinct(), "pairs")
    common.drop(apart)
    return pairs


def with_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents, written to the shared folder with a number of its own for each row, and the name of that column."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return common.saved(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def verdicts(given: DataFrame, width: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept and first of the rows of a written table (row, doc_id, text)."""
    signed = common.saved(given.select("row", "doc_id", "text").mapInArrow(_signatures(width, rows_per_band(percent / 100)), "row long, doc_id long, n_shingles long, same binary, bands array<long>, sketch binary"), "signatures")
    ident = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    reps = common.saved(signed.where("n_shingles > 0").groupBy("same").agg(F.min("row").alias("rep"), F.min(ident).alias("least")), "classes")
    # signatures are wide, and most rows have no copy: only rows that may be copies are shuffled to be told from their class's first, only keys that may be shared to meet their sizes, and only sketches that may be asked for
    copies = common.saved(signed.select("row", "same").join(reps.select("same", "rep"), "same").where("row <> rep").select("row"), "copies")
    maybe = common.may_be_in(copies, F.col("row"))
    shingled = signed.where("n_shingles > 0").select("row", "n_shingles", "bands", "sketch")
    classes = shingled.where(~maybe).unionByName(shingled.where(maybe).join(copies, "row", "left_anti")).select(F.col("row").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sketch")
    classes = common.saved(classes, "class-sketches")
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = common.saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    crowded = common.saved(rows.where(common.may_be_in(sizes.select("key"), F.col("key"))).join(sizes, "key"), "buckets")
    central = crowded.groupBy("rep").agg(F.sum("size").alias("central"))
    chunk = F.pmod(F.xxhash64("rep", "key"), F.ceil(F.col("size") / STAR)).cast("int")
    buckets = common.saved(crowded.join(central, "rep").select("key", chunk.alias("chunk"), "rep", "n", "central"), "central-buckets")
    wanted = common.may_be_in(buckets.select("rep"), F.col("rep"))
    every, classes = classes, common.saved(classes.select("rep", "sketch").where(wanted), "bucket-sketches")
    common.drop(sizes, crowded, copies, every)
    links = labels = None
    stars = _central_pairs(buckets, percent)
    sketches = [classes.select(F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    near = stars.join(sketches[1], "b").join(sketches[0], "a").select("a", "b", "na", "nb", "sketch_a", "sketch_b", "ca")
    # of the stars that a class may be linked with, the most central one; what that leaves apart, the blocks compare
    best = near.mapInArrow(_sketched(percent), "a long, b long, ca long").groupBy("b").agg(F.max(F.struct("ca", (-F.col("a")).alias("minus"))).alias("_p"))
    pairs = common.saved(best.select((-F.col("_p.minus")).alias("a"), "b"), "pairs")
    if not pairs.isEmpty():
        links = confirmed(pairs, given, width, percent)
        labels = components(links)
    common.drop(stars, pairs)
    pairs = _across(buckets, classes, labels, percent)
    if not pairs.isEmpty():
        more = confirmed(pairs, given, width, percent)
        links = more if links is None else links.union(more)
        labels = components(links)
    common.drop(pairs, buckets, classes)
    own = common.saved(_with_components(reps, labels), "class-components")
    least = common.redealt(own.groupBy("component").agg(F.min("least").alias("_least")), "component")
    of_class = common.saved(own.join(least, "component").select("same", F.col("_least.doc_id").alias("_id"), F.col("_least.row").alias("_first")), "class-verdicts")
    common.drop(own, reps)
    member = signed.drop("bands", "sketch").join(of_class, "same", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_id")).otherwise(F.col("doc_id"))
    first = F.coalesce(F.col("row") == F.col("_first"), F.lit(True))
    return member.select("row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, first).alias("kept"), first.alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (the smallest id reachable over links of at least percent % Jaccard similarity), kept (whether that is its own id) and first (one row of each component)."""
    given, row = with_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return verdicts(given.withColumnRenamed(row, "row"), width, percent).drop("row")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, without the rows that aren't the first of their component."""
    given, row = with_rows(docs)
    found = verdicts(given.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width, percent)
    gone = common.saved(found.where("not first").select(F.col("row").alias(row)), "gone")
    doubtful = common.may_be_in(gone, F.col(row))
    return given.where(~doubtful).unionByName(given.where(doubtful).join(gone, row, "left_anti")).select(*docs.columns)

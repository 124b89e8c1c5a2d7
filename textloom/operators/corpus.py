"""Filters, pre-token counts, alphabets and pair counts of a corpus."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def score_at_least(df: DataFrame, column: str, threshold: float | None) -> DataFrame:
    """Rows whose score reaches the threshold; nulls and NaN never do. Without a threshold all rows stay. An absent column is an error."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r} to filter by")
    if threshold is None:
        return df
    score = F.col(column).cast("double")
    return df.where((score >= F.lit(threshold)) & ~F.isnan(score))


def with_bos(df: DataFrame, bos: str, text_col: str = "text") -> DataFrame:
    """Each text with the document delimiter in front; null texts are dropped. Texts stay rows of their own, so the delimiter is always seen."""
    return df.where(F.col(text_col).isNotNull()).withColumn(text_col, F.concat(F.lit(bos), F.col(text_col)))


def chunk_counts(df: DataFrame, mode: str = T.BYTES, specials: tuple[str, ...] = (), text_col: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(chunk, cnt) over all texts, or for each value of the columns `by`; special tokens aren't counted. Counts are summed before they are shuffled."""
    chunks = df.select(*by, F.explode(T.pretokens(F.col(text_col), mode, specials)).alias("chunk"))
    if specials:
        chunks = chunks.where(~F.col("chunk").isin(*specials))
    return chunks.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("cnt"))


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Several counts added up; what isn't positive is dropped."""
    every = counts[0]
    for more in counts[1:]:
        every = every.unionByName(more)
    return every.groupBy("chunk").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def without(counts: DataFrame, specials: DataFrame) -> DataFrame:
    """Counts of chunks that aren't in the column `token` of another frame."""
    return counts.join(specials.select(F.col("token").alias("chunk")), "chunk", "left_anti")


def alphabet(counts: DataFrame) -> DataFrame:
    """(ch, code): the distinct characters of the chunks."""
    return counts.select(F.explode(T.characters(F.col("chunk"))).alias("ch")).distinct().select("ch", F.ascii("ch").alias("code"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(pair_left, pair_right, cnt): neighbouring characters within chunks, weighted by the chunks' counts."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("chunk") - 1), lambda i: F.substring(F.col("chunk"), i, F.lit(2)))
    rows = counts.where(F.length("chunk") > 1).select(F.explode(pairs).alias("pair"), "cnt").groupBy("pair").agg(F.sum("cnt").alias("cnt"))
    return rows.select(F.substring("pair", 1, 1).alias("pair_left"), F.substring("pair", 2, 1).alias("pair_right"), "cnt")


def best_pair(pairs: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the one that sorts first."""
    return pairs.orderBy(F.desc("cnt"), "pair_left", "pair_right").limit(1)


def extended_vocabulary(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """The vocabulary (id, token) with those tokens added that it lacks, in their order `ord`, with the next ids."""
    from pyspark.sql import Window

    top = vocabulary.agg(F.max("id").alias("top"))  # one row
    new = tokens.join(vocabulary, "token", "left_anti").groupBy("token").agg(F.min("ord").alias("ord"))
    ids = new.withColumn("n", F.row_number().over(Window.orderBy("ord", "token"))).join(F.broadcast(top)).select((F.coalesce("top", F.lit(-1)) + F.col("n")).cast("int").alias("id"), "token")
    return vocabulary.select("id", "token").unionByName(ids)


def missing_tokens(vocabulary: DataFrame, tokens: list[str]) -> list[str]:
    """Which of a few tokens the vocabulary lacks."""
    found = {r["token"] for r in vocabulary.where(F.col("token").isin(*tokens)).select("token").collect()}
    return [t for t in tokens if t not in found]


def file_subset(df: DataFrame, names: list[str] | None = None, indices: list[int] | None = None, first: int | None = None) -> DataFrame:
    """Rows of some of the input files: of the names, those at the given places (places out of range are ignored; if none is left, all files stay) or the first few; with both, the first few of the chosen. Names come from the plan's list of files, not from the rows."""
    names = sorted(names if names is not None else [unquote(x.rsplit("/", 1)[-1]) for x in df.inputFiles()])
    if indices is not None:
        names = [names[i] for i in indices if 0 <= i < len(names)] or names
    chosen = names[:first] if first else names
    return df.where(F.col("_metadata.file_name").isin(*chosen))

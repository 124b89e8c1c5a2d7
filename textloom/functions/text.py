"""Column expressions over text: pre-tokens, chat rendering, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alternatives of the pre-tokenizer, in order, for Python's engine.
#: A contraction, letters with at most one sign before them, up to three digits, signs with line ends, and two kinds of white space.
ALTERNATIVES = (
    r"'(?i:[sdmt]|ll|ve|re)",
    r"[^\r\n\w]?[^\W\d_]+",
    r"\d{1,3}",
    r" ?[^\s\w]+[\r\n]*",
    r"\s+(?!\S)",
    r"\s+",
)
BYTES, STR = "bytes", "str"


def pattern(mode: str = BYTES, specials: tuple[str, ...] = ()) -> str:
    """The pre-tokenizer for Spark's regex engine, special tokens first and the longest of them before others.

    In bytes mode classes are ASCII; the sign before letters must then be an ASCII one, since one
    character beyond ASCII is several bytes of which only the last could precede a letter. In str
    mode classes are Unicode's.
    """
    if mode not in (BYTES, STR):
        raise ValueError(f"mode must be {BYTES!r} or {STR!r}, not {mode!r}")
    parts = list(ALTERNATIVES)
    if mode == BYTES:
        parts[1] = r"[^\r\n\w\x{80}-\x{10FFFF}]?[^\W\d_]+"
    quoted = [r"\Q" + s + r"\E" for s in sorted(specials, key=len, reverse=True)]
    return ("(?U)" if mode == STR else "") + "|".join([*quoted, *parts])


def pretokens(text: Column, mode: str = BYTES, specials: tuple[str, ...] = ()) -> Column:
    """The chunks of a text in order; what no alternative matches (underscores) is dropped. Null for a null text."""
    return F.regexp_extract_all(text, F.lit(pattern(mode, specials)), F.lit(0))


def characters(text: Column) -> Column:
    """The characters of a text in order."""
    return F.array_remove(F.split(text, ""), "")


def code_points(text: Column) -> Column:
    """The code points of a text in order."""
    return F.transform(characters(text), F.ascii)


def chatml(messages: Column) -> Column:
    """`<|im_start|>role`, a line end, the content and `<|im_end|>` for each message, joined by line ends; none after the last."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>"))), "\n")


def shard_name(shard: Column) -> Column:
    """The file name of a shard number."""
    return F.format_string("shard_%04d.bin", shard)


def short_count(n: Column) -> Column:
    """A count with the suffix b, m or k once it exceeds that unit, and one decimal."""
    scaled = F.when(n > 1_000_000_000, n / 1e9).when(n > 1_000_000, n / 1e6).when(n > 1000, n / 1e3).otherwise(n.cast("double"))
    suffix = F.when(n > 1_000_000_000, "b").when(n > 1_000_000, "m").when(n > 1000, "k").otherwise("")
    return F.concat(F.format_string("%.1f", scaled), suffix)


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by colons: the same in any engine."""
    return md5_number(*parts) / F.lit(4294967296.0)


def md5_number(*parts: Column) -> Column:
    """The first 32 bits of the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")

"""One registered query for each operator of this subpackage, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_ngrams, common, content_sort, edit_counts, language_mixture, length_buckets, minmax_dedup, quality_forest, rotated_codes, token_links, token_orc, toxicity_grammar, trie_bpe, va_codes


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated_codes.nearest(common.table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0, 10)


def op2_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ngrams.class_bigram_scores(common.table(spark, sf_dir, "documents"))


def op3_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_counts.edit_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity_grammar.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5).alias("held_out"), "score", "predicted")


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(common.table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = common.table(spark, sf_dir, "documents"), common.scratch_path(spark, "tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_orc.checksums(token_orc.read_tokens(spark, path))


def op7_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_buckets.length_buckets(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_forest.quality_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_mixture.language_id(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", common.held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score", "n_langs")


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie_bpe.encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_va_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_codes.vector_codes(common.table(spark, sf_dir, "embeddings"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.token_links(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_rotated_codes": op1_rotated_codes,
    "op2_class_ngrams": op2_class_ngrams,
    "op3_edit_counts": op3_edit_counts,
    "op4_toxicity_grammar": op4_toxicity_grammar,
    "op5_minmax_dedup": op5_minmax_dedup,
    "op6_token_orc": op6_token_orc,
    "op7_length_buckets": op7_length_buckets,
    "op8_quality_forest": op8_quality_forest,
    "op9_language_mixture": op9_language_mixture,
    "op10_trie_bpe": op10_trie_bpe,
    "op11_va_codes": op11_va_codes,
    "op12_token_links": op12_token_links,
    "op13_content_sort": op13_content_sort,
    "pipeline": corpus_pipeline.run,
}
#: Words of a text in lower case for A-Z.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Links by counted common shingles of all pairs, then what each id reaches: exact, for small tables.
_NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v),
c AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id, c.low = d.doc_id AS kept, c.low = d.doc_id AS first FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def _vector_codes() -> str:
    """Four rounds over codebooks, one after the other, with every entry compared."""
    nearest = "SELECT vec_id, part, q, x.entry AS entry, x.d AS d FROM (SELECT p.vec_id, p.part, p.q, min(struct_pack(d := list_sum(list_transform(range(1, len(p.q) + 1), lambda i: (p.q[i] - b.q[i]) * (p.q[i] - b.q[i]))), entry := b.entry)) AS x FROM p JOIN b{n} b USING (part) GROUP BY ALL)"
    moved = "SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{n} b LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS q FROM (SELECT part, entry, i, floor(sum(q[i])::DOUBLE / count(*))::BIGINT AS v FROM a{n}, range(1, 17) r(i) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)"
    steps = ["e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"]
    steps += ["p AS MATERIALIZED (SELECT vec_id, k AS part, v[k * 16 + 1:k * 16 + 16] AS q FROM e, range(0, 4) r(k))"]
    steps += ["b0 AS MATERIALIZED (SELECT part, entry, q FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, q FROM p) WHERE entry < 256)"]
    for n in range(4):
        steps += [f"a{n} AS MATERIALIZED ({nearest.format(n=n)})", f"b{n + 1} AS MATERIALIZED ({moved.format(n=n)})"]
    steps += [f"a4 AS MATERIALIZED ({nearest.format(n=4)})"]
    steps += ["c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)"]
    steps += ["h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS h FROM b4)"]
    return "WITH " + ", ".join(steps) + " SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN e USING (vec_id), h"


_COPIES = r"""SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256 FROM (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents) WINDOW w AS (PARTITION BY bare ORDER BY n DESC, doc_id)"""
#: The others depend on fitted models, random rotations or a tokenizer; tests hold them against brute force, the library or held-out rows.
ORACLE_SQL = {"op5_minmax_dedup": _NEAR_DUPLICATES, "op11_va_codes": _vector_codes(), "op13_content_sort": _COPIES}

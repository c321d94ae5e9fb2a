"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import html, language, mixing, packing, quality, rollup, simhash, substring, topk, toxicity, upsert, vector_packing, whitening
from .common import shared_dir, table


#: The mixture that is asked for: a hot source held down, English at half, topics alike.
MIX = mixing.Mix(
    targets={
        "source": {"src0": 0.2, mixing.OTHERS: 0.8},
        "lang": {"en": 0.5, "fr": 0.15, "de": 0.15, "es": 0.15, mixing.OTHERS: 0.05},
        "topic": {**{f"topic-{k}": 1.0 for k in range(mixing.Topics.groups)}, mixing.OTHERS: 0.5},
    }
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def rollup_native_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op3 under counters that SQL can follow."""
    return rollup.maintained_totals(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = {v: public_tokenizers.path(f"{v}.json") for v in ("byte_bpe_50k", "word_bpe_49k")}
    return rollup.tokenizer_totals(table(spark, sf_dir, "documents"), files)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), MIX)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    return upsert.upsert_clients(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"), root)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of a document is one that a model learns to predict, so all bear loss."""
    placed = vector_packing.pack_examples(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_html_text, op3_token_counts, op4_packing, op5_language_id, op6_substring_dedup, op7_quality_rules, op8_topk_search, op9_mixing, op10_simhash, op11_upsert, op12_whitening, op13_vector_packing, rollup_native_counts)
    return {f.__name__: f for f in found}


#: Words and line rules as in quality.py, over DuckDB's regular expressions.
OP7 = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce("text", '') AS t FROM documents
), split AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM base
), tri AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) >= 3
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM tri) WHERE n >= 2
), covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r
), lines AS (
  SELECT r, x, len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
  FROM (SELECT r, unnest(list_distinct(l)) AS x FROM split)
), kept AS (
  SELECT r, count(*) AS n_kept, sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) AS chars
  FROM lines
  WHERE NOT (length(x) - length(regexp_replace(x, '[|»›•·]', '', 'g')) > 0.25 * n
          OR length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > 0.5 * n
          OR (n >= 8 AND NOT regexp_matches(x, '[.!?:;"'')\]…»”’]([\x20\x09-\x0D]|$)'))
          OR regexp_matches(x, '(all rights reserved|cookie policy|privacy policy|terms of (use|service)|copyright \(c\)|subscribe to our|sign up for|click here|enable javascript|lorem ipsum|permission is hereby granted|licensed under the)', 'i'))
  GROUP BY r
), counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
         CAST(coalesce(chars, 0) AS BIGINT) AS kept_chars
  FROM split LEFT JOIN covered USING (r) LEFT JOIN kept USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_chars >= 0.5 * word_chars AS kept,
       n_lines, n_lines - n_kept AS n_lines_removed, kept_chars
FROM counted
"""


#: What is left after all batches: byte counts without surrounding blanks and the second word counter.
ROLLUP = r"""
WITH base AS (
  SELECT source, lang, coalesce("text", '') AS t FROM documents
), counted AS (
  SELECT source, lang, len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words,
         strlen(regexp_replace(regexp_replace(t, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')) AS bytes,
         length(t) - length(regexp_replace(t, '[.,;:!?|]', '', 'g')) AS marks
  FROM base
), kept AS (
  SELECT source, lang, unnest(['bytes-1', 'words-2']) AS tokenizer, unnest([bytes, words + marks]) AS n FROM counted
)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM kept GROUP BY ALL
"""

#: Every pair of a query and another row, by exact integer products.
OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v r WHERE q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id AND len(q.x) = len(r.x)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Windows of 20 words grouped as lists; of equal ones, all but the first place are repeats.
OP6 = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM split WHERE len(w) >= 20
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM later, (SELECT unnest(range(20)) AS o)
), gone_of AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: g IS NULL OR NOT list_contains(g, k)), lambda k: w[k]), ' ')) AS kept_sha256
FROM split LEFT JOIN gone_of USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"rollup_native_counts": ROLLUP, "op6_substring_dedup": OP6, "op7_quality_rules": OP7, "op8_topk_search": OP8}

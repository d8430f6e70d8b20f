"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from batchloom.llm import gif, leaks, neardups, packing, quality, repeats, tokens, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.tiktoken", at: str | None = None) -> str:
    """The place of a vocabulary file: in folder ``at``, or else where the installed tokenizers are."""
    if at is None:
        found = importlib.util.find_spec("public_tokenizers")
        at = str(Path(found.origin).parent) if found else "/opt/tokenizers"
    return f"{at}/{name}"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(_table(spark, sf_dir, "documents"), vocabulary=vocabulary())


def op2_gif_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    # no table holds media: each vector is drawn as an animated file, and that is decoded
    return gif.decode_frames(gif.rendered(_table(spark, sf_dir, "embeddings")), id_column="vec_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"), method="sketch")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(_table(spark, sf_dir, "documents"), method="radix")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardups.near_groups(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


#: Maximal runs of word windows that occur twice or more, first occurrences apart from later ones.
REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT doc_id, unnest(range(len(ws) - 49)) AS p, ws FROM w WHERE len(ws) >= 50
), keyed AS (
  SELECT doc_id, p, md5_number(array_to_string(ws[p + 1 : p + 50], ' ')) AS k FROM win
), marked AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) = 1 AS is_first FROM keyed
), runs AS (
  SELECT doc_id, p, is_first, p - row_number() OVER (PARTITION BY doc_id, is_first ORDER BY p) AS g FROM marked WHERE n > 1
)
SELECT doc_id, CAST(min(p) AS INTEGER) AS start_word, CAST(max(p) + 50 AS INTEGER) AS end_word, CAST(count(*) AS INTEGER) AS n_windows, is_first
FROM runs GROUP BY doc_id, is_first, g
"""


#: Components of all pairs with a weighted Jaccard index of 0.5 or more, each pair compared.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), e AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || chr(10) || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0
), c AS (
  SELECT doc_id, g, count(*) AS n FROM e GROUP BY doc_id, g
), t AS (
  SELECT doc_id, sum(n) AS s FROM c GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS i FROM c x JOIN c y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), edges AS (
  SELECT a, b FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b WHERE 2 * i >= x.s + y.s - i
), ways AS (
  SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges
), reach AS (
  SELECT a AS doc_id, a AS g FROM ways UNION SELECT ways.b, reach.g FROM reach JOIN ways ON ways.a = reach.doc_id
)
SELECT doc_id, min(g) AS group_id, doc_id = min(g) AS is_kept FROM reach GROUP BY doc_id
"""

QUERIES = (
    op1_token_counts,
    op2_gif_frames,
    op3_decontamination,
    op4_url_filter,
    op5_substring_dedup,
    op6_toxicity,
    op7_suffix_array_dedup,
    op8_quality_classifier,
    op9_near_dedup,
    op10_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": urls.judge_sql(), "op5_substring_dedup": REPEATS_SQL, "op7_suffix_array_dedup": REPEATS_SQL, "op9_near_dedup": NEAR_SQL}

"""The ``opN_`` queries: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from .common import table
from .ctw import language_model_scores
from .language import language_predictions
from .linededup import dedup_lines
from .media import media_round_trip
from .packing import pack_documents
from .quality import quality_scores
from .simhash import simhash_groups
from .tiling import tile_matches
from .tokenfiles import token_files_round_trip
from .urlfilter import filter_urls


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents"))


def op2_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_predictions(table(spark, sf_dir, "documents"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_progressive_jpeg, op2_nb_svm_quality, op3_language_viterbi, op4_simhash_golay, op5_best_fit_packing, op6_url_trie, op7_token_files, op8_greedy_tiling, op9_context_tree_weighting, op10_fuzzy_lines)}

ORACLES: dict[str, str] = {
    "op6_url_trie": r"""
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (
  SELECT page_id, host, path, max(struct_pack(n := length(h) + length(p), h := length(h), rule := h || p, verdict := v)) AS r
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, 'allow') AS verdict FROM best
""",
}

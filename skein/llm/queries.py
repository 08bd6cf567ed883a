"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, language_model, lines, manifest, mixing, neighbours, packing, quality_rules, search, simhash, substrings, toxicity, url_filters
from .common import documents, table

TOKENIZER = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.without_repeated_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(documents(spark, sf_dir)))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_simhash_near_dedup, op4_nearest_neighbours, op5_quality_classifier, op6_line_dedup, op7_toxicity, op8_source_mixing, op9_best_fit_packing, op10_substring_dedup, op11_ranked_search, op12_url_filters, op13_merkle_manifest)}
ORACLE_SQL = {"op2_quality_rules": quality_rules.OP2_SQL, "op8_source_mixing": mixing.OP8_SQL, "op10_substring_dedup": substrings.OP10_SQL, "op11_ranked_search": search.OP11_SQL, "op13_merkle_manifest": manifest.OP13_SQL}

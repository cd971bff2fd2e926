"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import cover_tree, hard_negatives, lang_id, license_scan, line_dedup, mixing, packing, phrase_index, secret_scan, simhash, tile_search, toxicity, whitening
from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.digest(table(spark, sf_dir, "embeddings"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_search.digest(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.default_tokenizer())


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    language = secret_scan.learn_language(docs)
    forest = secret_scan.fit_forest(secret_scan.all_findings(spark), language)
    return secret_scan.digest(secret_scan.scan_secrets(docs, forest, language=language))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.digest(toxicity.score_toxicity(docs, model))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lang_id.with_held_out(lang_id.identify(docs, lang_id.fit(docs)))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.digest(phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_nearest_neighbours": op2_nearest_neighbours,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_license_scan": op5_license_scan,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_decontamination": op11_decontamination,
    "op12_whitening": op12_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_top_k": cover_tree.ORACLE_SQL,
    "op2_nearest_neighbours": tile_search.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op11_decontamination": phrase_index.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}

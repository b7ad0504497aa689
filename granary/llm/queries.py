"""The queries of this folder and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, fim, gru, html, jaccard, jpeg, langid, linededup, lloyd, order, packing, quality, trie
from granary.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.stored_texts(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.materialised(table(spark, sf_dir, "documents"), key=20)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.scores(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.classes(table(spark, sf_dir, "documents"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_ngram_jaccard, op4_main_text, op5_media_columns, op6_bpe, op7_packing, op8_training_order, op9_lm_scores, op10_line_dedup, op11_fill_in_middle, op12_simhash_trie, op13_delta_lloyd)}


def oracle_sql() -> dict[str, str]:
    return {"op11_fill_in_middle": fim.SQL, "op13_delta_lloyd": lloyd.SQL}

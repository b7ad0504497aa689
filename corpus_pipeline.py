"""A corpus from documents: quality, language, repeated lines, near copies, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import jaccard, langid, linededup, packing, quality
from granary.llm.common import cut, prepare, release


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior reject go."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go; the models learn from the documents at hand."""
    return langid.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs go from the texts, and documents that are nothing else."""
    return linededup.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, a similarity of 0.8 or more) one document stays."""
    return jaccard.one_of_each(docs, percent=80, width=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("packing", pack)]
#: The stages learn, sketch and pack, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = cut(out)
        release(out)  # what the stage held has been read
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import quality_crf, toxicity
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.packing import packed_documents
from tessera.llm.queries import tokenizer_path
from tessera.llm.scratch import materialize


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled rows of ``docs``."""
    return toxicity.not_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled rows of ``docs``."""
    return quality_crf.good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Near copies share 80 % of their five-word shingles or more. 28 of 72 symbols may differ, which a pair at exactly 80 %
    exceeds with a probability under 1e-4. Rows without an id stay, and so do all rows of an id that stays.
    """
    dropped = near_duplicates(docs, k=5, percent=80, differ=28).where(~F.col("kept")).select("doc_id").distinct()
    # Sorted by id at every size: the dropped ids grow with the corpus and are never broadcast.
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their ids and their places in training sequences."""
    return packed_documents(docs, tokenizer_path("word_bpe_49k.json"), keep_ids=True, times_mean=32)


STAGES = [("toxicity", not_toxic), ("quality_classifier", good_quality), ("near_dedup", near_dedup), ("best_fit_packing", packing)]

#: Neither a trained field nor a tokenizer is expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

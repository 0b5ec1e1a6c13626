"""Corpus pipeline: toxic and poor documents go, recurring lines go, one of each near-duplicate group stays, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import common, line_templates, lsh_forest, packing, quality, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above the threshold of their language go."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that had nothing else; n_chars is that of the new text."""
    out = line_templates.without_recurring(docs).where("not emptied")
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.select(*[changed.cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else c for c in docs.columns])


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return lsh_forest.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; the workers still hold some memory of earlier stages, so lean."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), lean=True)


STAGES = [("toxicity", toxic_out), ("quality", poor_out), ("line_dedup", lines_out), ("near_dedup", near_out), ("packing", packed)]
#: Trained models, tokenizers and exact near-duplicate graphs can't be written in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stored(docs)
    return docs

"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Every stage works on what the stage before it kept; each but the last returns the columns of ``documents``.
Stages (name, function) take (spark, docs, sf_dir). Null ids and texts pass through every stage: a null text is
neither toxic nor contaminated and is packed as an empty document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import decontaminate, near_dup, packing, pii, queries, toxicity
from refrain.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects (score of 0.5 or more)."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model) < 0.5)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.survivors(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text where it was set."""
    changed = docs.withColumn("text", pii.redact_column())
    return changed.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast("long")) if "n_chars" in docs.columns else changed


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("near_dup", near_dup_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Trees, sketches and a random field have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, spark)
    return docs

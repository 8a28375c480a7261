"""The corpus pipeline: from raw documents to packed training sequences.

Each stage calls one operator of ``ferrule.llm`` on all that the stage before it
kept.  Stages are written as Parquet and read again in between, so a lost
executor repeats work of one stage only, and row keys are stable within a stage.
All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import chunk_recipes, common, decontaminate, packing, simhash, weak_labels
from ferrule.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier scores 0.3 or more go."""
    return weak_labels.clean(docs, common.read(spark, sf_dir, "labels", "doc_id", "toxic"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the longest original stays."""
    return chunk_recipes.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs of similar five-word shingle sets (0.8 or more) connect, one stays."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark", "item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left, in sequences of at most 2048."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The corpus pipeline: documents that pass each stage go on to the next, and the last mixes them.

Every stage reads all that its predecessor kept. Labels and test items are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buyerlens.llm.contamination import drop_leaks
from buyerlens.llm.lines import drop_recurring_lines
from buyerlens.llm.mixing import mix
from buyerlens.llm.quality import keep_good
from buyerlens.llm.simhash import keep_one
from buyerlens.llm.text import table
from buyerlens.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates, lines of one token too; ``n_chars`` is that of the text left."""
    kept = drop_recurring_lines(docs, min_tokens=1)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

# Classifier, fingerprints and search have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name.replace(' ', '-')}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs

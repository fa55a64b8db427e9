"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, encoding, in this order."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tallybox.llm import stages
from tallybox.session import remove, shared_folder

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("sentencepiece", stages.sentencepiece),
]

#: Trained scores, sketches and encodings are not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written as Parquet in the shared folder and read again, and goes when the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    return docs

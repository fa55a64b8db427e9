"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybox.llm.common import packed, table
from tallybox.llm.decontaminate import drop_contaminated
from tallybox.llm.line_dedup import dedup_lines
from tallybox.llm.near_dedup import drop_near_duplicates
from tallybox.llm.pieces import decode, encode
from tallybox.llm.queries import model_file
from tallybox.llm.toxicity import score_toxicity

TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go. All labels teach: the held-out fold is for measuring only. Null and empty texts stay;
    equal rows share a verdict; an empty table gives an empty one."""
    rows = packed(docs, F.col("doc_id"), F.col("text"))
    return score_toxicity(rows, table(spark, sf_dir, "labels"), F.lit(True), keep=["_row"]).filter(F.col("score") < TOXIC).select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site lines go from the texts; every document stays, null texts as null, and of equal lines the first occurrence."""
    return dedup_lines(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one of the smallest id. Null, empty and wordless texts stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, `ids`, and `round_trip`: whether they decode to the text. Columns of these two names are replaced. A null text has null ids."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # no name clashes, and the text passes once
    text = f"_c{docs.columns.index('text')}"
    coded = decode(encode(plain, model_file(), text_col=text, keep=plain.columns), model_file())
    names = [F.col(c).alias(name) for c, name in zip(plain.columns, docs.columns, strict=True) if name not in ("ids", "round_trip")]
    return coded.select(*names, "ids", F.col("decoded").eqNullSafe(F.col(text)).alias("round_trip"))

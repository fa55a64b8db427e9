"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybox.llm.common import table
from tallybox.llm.decontaminate import decontaminate
from tallybox.llm.divergence import audit_sources
from tallybox.llm.filter_audit import audit_filters
from tallybox.llm.licenses import notices, scan_licenses
from tallybox.llm.line_dedup import dedup_lines
from tallybox.llm.near_dedup import near_duplicates
from tallybox.llm.pages import extract_pages
from tallybox.llm.pieces import decode, encode
from tallybox.llm.quality import score_quality
from tallybox.llm.substring_dedup import remove_repeats
from tallybox.llm.toxicity import score_toxicity
from tallybox.llm.vectors import near_vectors
from tallybox.llm.weak_rules import judge


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"), notices(spark))
    return out.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"),
                      F.size("spans").cast("long").alias("n_spans"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def model_file() -> str:
    """The public BPE model's path, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents"), model_file(), keep=["doc_id", "text"]), model_file())
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _fold():
    """crc32 of the id's text mod 5; rows of fold 0 are held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def _scored(out: DataFrame, threshold: float) -> DataFrame:
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold() != 0)
    return _scored(out, 0.3)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_repeated", "n_around", "n_around_repeated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _fold() != 0)
    return _scored(out, 0.5)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_sentencepiece, op3_quality, op4_substring_dedup, op5_license_scan,
                                   op6_embedding_near_dedup, op7_near_dedup, op8_line_dedup, op9_html_extraction, op10_toxicity, op11_source_divergence, op12_quality_rules, op13_filter_audit)}

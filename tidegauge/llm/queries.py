"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.decontamination import find_items
from tidegauge.llm.fingerprints import edited_and_next
from tidegauge.llm.hard_negatives import OP12_SQL, hard_negatives
from tidegauge.llm.jaccard_join import OP7_SQL, OP11_SQL, similar_documents
from tidegauge.llm.language_id import identify
from tidegauge.llm.line_dedup import OP2_SQL, dedup_lines
from tidegauge.llm.minhash_dedup import near_duplicates
from tidegauge.llm.periodic_runs import OP13_SQL, periodic_runs, run_digests, with_repeats
from tidegauge.llm.personal_data import find_personal_data
from tidegauge.llm.piece_codec import encode_decode
from tidegauge.llm.substring_dedup import OP4_SQL, dedup_windows
from tidegauge.llm.suffix_dedup import dedup_bytes
from tidegauge.llm.token_counts import count_tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return count_tokens(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    clean = dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return clean.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), digest)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses of every document."""
    return edited_and_next(_docs(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return dedup_windows(_docs(spark, sf_dir))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return encode_decode(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return dedup_bytes(_docs(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return similar_documents(_docs(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    return identify(_docs(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and the number of added spans of every document."""
    found = find_personal_data(_docs(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "added")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, end_pos of every benchmark item found in a document."""
    return find_items(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(_docs(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; anchors are the rows whose vec_id is divisible by 50."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, two digests, of every document with its repeats."""
    return run_digests(periodic_runs(with_repeats(_docs(spark, sf_dir))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_fingerprints": op3_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_personal_data": op9_personal_data,
    "op10_decontamination": op10_decontamination,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op11_minhash_dedup": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}

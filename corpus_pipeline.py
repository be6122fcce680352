"""From raw documents to token ids in five stages, each one operator over all that its predecessor kept.

1. Language ID: documents that are too far from every language's centroids, or hold no letter, go.
2. Line dedup: later occurrences of three-line windows leave the texts; a text that loses every line goes.
3. n-gram Jaccard join: of documents linked by similar 5-word shingle sets (80 %), the one with the least id stays.
4. Benchmark decontamination: documents that hold a benchmark item within its error budget go.
5. SentencePiece: every text is encoded and decoded; one row per document with digests of its ids and its decoded text.

Null texts are rejected by stage 1. Rows without an id pass stages 2 to 4 unless they hold a benchmark item. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.columns import col
from tidegauge.llm.decontamination import mark_contaminated
from tidegauge.llm.jaccard_join import BROADCAST_IDS, similar_documents
from tidegauge.llm.language_id import fit, held_out, keep_known
from tidegauge.llm.line_dedup import dedup_lines
from tidegauge.llm.piece_codec import encode_decode
from tidegauge.shared import materialise

#: Words of a shingle and least similarity in hundredths of the near-duplicate stage.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is in a learnt language; all columns. Null, empty and letterless texts go."""
    return keep_known(docs, fit(docs.where(~held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with repeated lines cut out and n_chars counted anew; a text that loses every line goes. All columns."""
    clean = dedup_lines(docs)
    n_lines, n_removed = map(F.col, clean.columns[-2:])
    clean = clean.where(~((n_removed > 0) & (n_removed == n_lines)))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*map(col, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without those whose component has a smaller id. Rows without an id stay. All columns."""
    found = similar_documents(docs.select("doc_id", "text"), k=NEAR_SHINGLE, percent=NEAR_PERCENT)
    others = materialise(found.where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    few = others.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(others) if few else others, "doc_id", "left_anti").select(*map(col, docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in whose text no benchmark item stands within its error budget. All columns."""
    marked = mark_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col(marked.columns[-1])).select(*map(col, docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, one row per row."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", lines),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("piece_codec", pieces),
]

#: SQL can express neither the centroids of stage 1, the edit distance of stage 4 nor the merges of stage 5.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

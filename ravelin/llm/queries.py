"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import language
from ravelin.llm.chunk_dedup import chunk_dedup
from ravelin.llm.common import table
from ravelin.llm.conversation import repair
from ravelin.llm.divergence import audit
from ravelin.llm.lm_score import lm_scores
from ravelin.llm.minhash import near_duplicates
from ravelin.llm.packing import pack
from ravelin.llm.personal import identifiers
from ravelin.llm.pieces import piece_digests
from ravelin.llm.quality_lines import line_rules
from ravelin.llm.suffix_dedup import suffix_dedup
from ravelin.llm.token_spans import section_tokens
from ravelin.llm.topk import top_k


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_scores(table(spark, sf_dir, "documents"), targets)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), 5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs.select("doc_id", "text"), language.fit(docs)).drop("row")


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(table(spark, sf_dir, "documents")).drop("spans", "kept_bytes")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "label")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(table(spark, sf_dir, "documents"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans", "kept_bytes")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_packing": op2_packing,
    "op3_topk": op3_topk,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language": op5_language,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_minhash": op7_minhash,
    "op8_token_counts": op8_token_counts,
    "op9_line_frequency": op9_line_frequency,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_personal_data": op11_personal_data,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_repair": op13_conversation_repair,
}

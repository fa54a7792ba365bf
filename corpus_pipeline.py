"""A corpus from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. A stage's result is lazy: what the stage keeps for itself lasts as long as a DataFrame reads it, so stages
can be composed, repeated and run side by side. All but the last give the columns of docs, whatever their names; n_chars
follows the text. An empty table goes through every stage as an empty table; very long texts go through whole. Of ties
the first in the stated order stays: the smallest id in near-dedup and substring dedup; where ids are equal, rows keep alike
in substring dedup, and one of them stays in near-dedup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import language
from ravelin.llm.chunk_dedup import chunk_dedup
from ravelin.llm.common import kept_table, sweep, table
from ravelin.llm.minhash import near_duplicates
from ravelin.llm.packing import pack
from ravelin.llm.quality_lines import line_rules

#: Documents whose best language has less support are rejected: they are like none of the learned ones.
LEAST_SUPPORT = 0.38
#: Near duplicates share so many percent of their 5-word shingles.
NEAR_PERCENT = 80


def _columns(docs: DataFrame, row: str, text: Column, **given: Column) -> list[Column]:
    """The columns of docs in their order, from a struct of the others and a new text."""
    made = {"text": text, "n_chars": F.char_length(text).cast("long"), **given}
    return [(made[c] if c in made else F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the line rules (null and empty texts among them); removes frequent lines from the others.

    Rows equal in every column are judged alike; a null source is a host of its own.
    """
    kept = line_rules(docs, carry=True)
    return kept.select(*_columns(docs, "row", F.col("clean_text")))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language that can be told (null texts and those without a letter among them); lang becomes the one told.

    Repeated rows get the same language; rows with a null id or lang are told, never learned from.
    """
    told = language.identify(docs, language.fit(docs), support=True).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("support") >= LEAST_SUPPORT))
    return told.select(*_columns(docs, "row", F.col("row.text"), lang=F.col("lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id; of rows with it, repeated ones too, one.

    A row without an id stays only where its group has none with one. Texts without words are linked with nothing and stay.
    """
    base = kept_table(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*docs.columns).alias("row")), "near")
    found = near_duplicates(base.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), percent=NEAR_PERCENT, rid_col="rid")
    found = kept_table(found.select("rid", "doc_id", "label"), "found")
    first = found.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x"))
    stay = first.select("x.rid").unionByName(found.where("label IS NULL").select("rid"))
    return base.join(stay, "rid", "left_semi").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages but for their first place: in the document with the smallest id.

    Rows with one id keep alike; a null text stays empty; no row goes.
    """
    cut = chunk_dedup(docs, carry=True)
    return cut.select(*_columns(docs, "row", F.col("kept_bytes").cast("string")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024. Repeated rows and rows without an id are packed one by one; a null text is its closing id."""
    return pack(docs)


STAGES = [("quality rules", quality), ("language ID", languages), ("MinHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, now=True)  # what the stage kept for itself, and what the stage before it gave
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenising, kernels and chunking are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None

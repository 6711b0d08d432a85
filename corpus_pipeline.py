"""Corpus pipeline over ``documents``: quality rules, exact dedup, SimHash near-dedup, packing.

A stage takes the documents that its predecessor kept, whole, and returns documents
with the same columns; the last returns their pieces packed into sequences. In the
first stage the rules decide which documents go; the texts of those that stay are
not touched. (``quality_rules.without_common_lines`` gives the stripped texts. Here
they would part copies: a line goes on one host and stays on another, and stays in
the first document that holds it, so the stages after would miss equal texts.)

Defined cases, in every stage: null and empty texts have no words and are rejected by
the first stage; a text of any length is one document; of equal texts the row with
the largest id stays, of rows that repeat one, of near copies the smallest id; rows
without an id are rejected or kept like others by the first two stages and are never
dropped as near copies; nulls in other columns, and other columns of any name, stay
as they are; tables without rows give tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticktide.llm import common, exact_dedup, packing, quality_rules, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the largest id, of each group of equal texts."""
    index = exact_dedup.DigestIndex(spark, common.new_path(spark, "digest_index"))
    out = exact_dedup.keep_one(docs, index)
    index.forget()
    return out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("SimHash near-dedup", near), ("best-fit packing", pack)]
#: Fingerprints and tokenization have no SQL; tests/llm hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)

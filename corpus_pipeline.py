"""A corpus pipeline of the training-data operators: one stage after another, each written and read again.

Every stage takes any table with doc_id, text, lang and source.  Null texts count as empty, rows that
repeat are rows of their own, ties go to the smaller id, other columns pass through whatever their
names, and an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import mixing, ngram_jaccard, pii, quality_rules, sentencepiece_bpe
from lectern.llm.common import began, released, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, as they are; null and empty texts have no words and go."""
    began()
    return quality_rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that 5-word shingles at 80 % connect.

    Documents without words or without an id are in no group and stay."""
    released(spark, docs)
    return ngram_jaccard.representatives(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; null texts stay null, n_chars follows the text."""
    released(spark, docs)
    return pii.masked(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources repeated as the mixture's weights say; a null source is a source."""
    released(spark, docs)
    return mixing.mixed(docs, carry=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture; a null text is encoded as an empty one."""
    released(spark, docs)
    return sentencepiece_bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixture", mixture), ("encoding", encoding)]

#: Fertility, iterative extraction and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

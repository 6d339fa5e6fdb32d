"""The corpus pipeline: filter, deduplicate, decontaminate, mask and pack the table documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontamination, minhash, packing, secrets, toxicity
from marginalia.llm.common import few, table, written
from marginalia.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the table labels, scores below 0.5.

    Null and empty texts are scored as no words and stay; repeated rows go or stay together; an
    empty table stays empty; without labels of both kinds nothing goes. A score of 0.5 goes.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least doc_id.

    Null, empty and blank texts are in no group and stay, as do rows without a doc_id. Rows that
    repeat a kept doc_id all stay. An empty table stays empty.
    """
    return few(minhash.drop_near_duplicates(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the table benchmark.

    Null and blank texts hold none; null and blank items are in no document; repeated rows go or
    stay together; an empty table, or an empty benchmark, changes nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked.

    Null and empty texts stay as they are, as do repeated rows; n_chars follows the text.
    """
    return secrets.mask_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences.

    Null and empty texts are a piece of the end id alone; repeated rows are packed each; ties in
    length go in the order of rows; an empty table has no pieces.
    """
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Not expressible: a trained classifier, a trained forest and a tokenizer decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

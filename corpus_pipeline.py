"""From raw documents to packed sequences, in five stages, each written and read again by the next.

All stages but the last return rows of documents as they are, with all columns, whatever else these are called. No stage
fails on nulls in any column, empty or very long texts, ties, repeated rows or empty tables; what becomes of them is
said with each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm._common import materialise, table
from tarn.llm.content_sort import content_sort
from tarn.llm.decontaminate import keep_clean
from tarn.llm.minhash import keep_first
from tarn.llm.packing import pack_documents
from tarn.llm.quality import fit_quality, keep_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Null and empty texts score by the model's constant, which the commoner label rules; repeated rows are judged each;
    labels of null id or value teach nothing. Without labels every score is 0.5, and all documents stay.
    """
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the smallest id, and of rows that repeat it exactly one.

    Null texts count as empty, and so equal each other; null ids come last. An empty table stays empty.
    """
    return content_sort(docs, only_kept=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: those linked at a similarity of 80 in 100 or more.

    Null texts and texts without words are linked with nothing and stay, as do rows of null id. Rows of one id are one
    document and stay or go together. An empty table stays empty.
    """
    return keep_first(docs, threshold=(80, 100))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of 13 words (or whole item of fewer) of the benchmark occurs.

    One occurrence is enough for a document to go, however long it is. Null texts and texts without words stay; repeated
    rows are judged each. Benchmark items of null id, null text or no words have no windows; without any, all stay.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"), share=(0, 1))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes, in sequences of at most 1024 tokens.

    Null text is the end id alone; each row is a document of its own, null and repeated ids included, of one piece or,
    if it is longer than a sequence, several. An empty table packs into nothing.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", clean), ("packing", packed)]
#: SQL can't express the classifier, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

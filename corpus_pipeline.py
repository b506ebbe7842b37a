"""A corpus pipeline: language, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes what the one before it kept. All but the last return the columns of the documents.

Rows, in all stages: other columns are kept as they are, whatever their names, and not read (but `lang` by the first
stage); an empty table gives an empty table; very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.llm import decontaminate, langid, packing, secrets, shingles, simhash
from eddyline.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the labelled rows teach; others and those without a letter go.

    Null and empty texts have no letter. Repeated rows are judged alike; a null doc_id is not learned from but judged.
    With fewer than 20 held-out labels every text with a letter stays.
    """
    return langid.keep_learned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts are copies of each other. Of repeated rows, and of rows of one id in one group, one stays;
    an id with texts in several groups keeps one row in each that it leads. Rows without an id stay.
    """
    return simhash.first_of(docs, shingles.near_copies(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none and stay; repeated rows go or stay together; ids are not read.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by marks.

    Null texts stay null; n_chars follows a changed text; repeated rows are masked alike; ids are not read.
    """
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens.

    A null or empty text is its end token alone; repeated rows are documents of their own; a null doc_id stays null.
    """
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secrets", secret_spans),
    ("packing", sequences),
]

#: SQL can express neither the trained model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that packing returns, each stage's output stored as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

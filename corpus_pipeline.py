"""The corpus pipeline: language, lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result as Parquet in the shared folder and reads it again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqharvest.llm import decontaminate, jaccard_join, langid, line_dedup, packing
from seqharvest.llm.common import word_array
from seqharvest.llm.queries import piece_vocabulary, table
from seqharvest.storage import steps, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior below which a text's language counts as unknown.
LEAST_SCORE = 0.5

# SQL can't express the piece model, the MinHash forest's neighbours or the boundaries' program; tests compare the stages with brute force.
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language (null, without a letter, or unsure) go; a missing lang is filled in."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, vocab_path=piece_vocabulary(), sample_by=F.xxhash64("doc_id"))
    found = langid.predict(docs, model, keep=list(COLUMNS), out=("lang_pred", "lang_score"))
    found = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first; documents left without a line go with them.

    Null, empty and blank texts recur nowhere and stay; equal rows count as one and stay alike.
    """
    return _sized(line_dedup.dedup(docs.select(*COLUMNS), drop_emptied=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that are alike, the first by doc_id stays (nulls last); of equal rows, one.

    Null texts and texts without words are like no other and stay.
    """
    return jaccard_join.one_of_each(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go.  Null and empty texts stay; equal rows are treated alike."""
    return _sized(decontaminate.strip(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=10))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's length bucket, batch and place; a null or empty text has length 0, equal rows get places of their own."""
    return packing.pack(docs, keep=["doc_id"], length=F.size(word_array(F.coalesce("text", F.lit("")))))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with steps(spark):
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)

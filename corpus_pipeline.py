"""The training-data pipeline: each stage is one operator over all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the docs of the next. All but the last return the columns of
documents; the last returns the mix.

Defined results: null and empty texts are rejected by the first stage; an empty table
passes through as an empty table. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.llm import common, decontaminate, line_dedup, mixing, ngram_join, quality_classifier

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep(docs.select(*COLUMNS), common.table(spark, sf_dir, "labels"), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out; n_chars follows the text, and a
    document of which only blanks are left goes."""
    out = line_dedup.dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.where((F.col("lines_removed") == 0) | (F.col("lines_removed") < F.col("lines_before"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Size, target of the source, copies and words taken of each document."""
    out = mixing.mix(docs.select(*COLUMNS))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

#: The classifier and the copies of the mix can't be expressed in SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Queries of file sources (round trips through the shared folder) and of judgments."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.plans.storage import shared_folder
from evalquarry.registry import on
from evalquarry.sources import files


def _folder(ev: Evidence) -> str:
    return f"{shared_folder(ev.spark)}/evalquarry/files-{uuid.uuid4().hex}"


@on("L", "SELECT CAST(item_id AS VARCHAR) AS doc_id, text FROM benchmark")
def S01_corpus_scan(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    ev("benchmark").select(F.col("item_id").cast("string").alias("id"), "text").write.json(path)
    return files.corpus(ev.spark, path).select("doc_id", "text")


@on("V", "SELECT query_id, doc_id, CAST(1 AS INT) AS grade FROM qrels WHERE grade > 0")
def S02_queries_scan(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    ev("qrels").where("grade > 0").groupBy("query_id").agg(F.first("query_id").alias("text"), F.collect_list("doc_id").alias("relevant_doc_ids")).write.json(path)
    return files.queries(ev.spark, path)[1]


@on("V", "SELECT query_id, doc_id, grade FROM qrels")
def S03_qrels_scan(ev: Evidence) -> DataFrame:
    path = _folder(ev)
    ev("qrels").select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("grade").cast("string")).alias("value")).write.text(path)
    return files.qrels(ev.spark, path)


@on("V", "SELECT query_id, doc_id, CASE WHEN grade = 0 THEN 5 ELSE grade END AS grade FROM qrels")
def R38_qrels_merge(ev: Evidence) -> DataFrame:
    q = ev("qrels")
    return files.merge_qrels(q, q.where("grade = 0").withColumn("grade", F.lit(5)))


@on("V", "SELECT query_id, doc_id, grade + 1 AS grade FROM qrels")
def J13_conflict_rule_max(ev: Evidence) -> DataFrame:
    q = ev("qrels")
    return files.resolved_conflicts(q.withColumn("seq", F.lit(1)).union(q.withColumn("grade", F.col("grade") + 1).withColumn("seq", F.lit(2))), "max")


@on("V", "SELECT query_id, doc_id, grade FROM qrels")
def J13_conflict_rule_first(ev: Evidence) -> DataFrame:
    q = ev("qrels")
    return files.resolved_conflicts(q.withColumn("seq", F.lit(1)).union(q.withColumn("grade", F.col("grade") + 1).withColumn("seq", F.lit(2))), "first")


@on("V", "SELECT query_id, doc_id FROM qrels WHERE grade >= 2")
def J14_relevant_entities(ev: Evidence) -> DataFrame:
    return ev("qrels").where("grade >= 2").select("query_id", "doc_id")

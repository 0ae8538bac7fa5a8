"""How candidates end: outcome kinds, losses by operator, and identity checks between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("relevant_retained", "irrelevant_removed", "irrelevant_retained", "relevant_lost_upstream", "relevant_dropped_at_stage", "unknown_relevance", "lineage_incomplete")


def outcome(judgment: Column, membership: Column, observed: Column, boundary: Column) -> Column:
    """Kept: by its judgment. Not kept: never seen is lost upstream, an exit that no one recorded is
    incomplete, else dropped where it was."""
    kept = F.when(judgment == "relevant", "relevant_retained").when(judgment == "nonrelevant", "irrelevant_retained").otherwise("unknown_relevance")
    gone = F.when(judgment == "unknown", "unknown_relevance").when(judgment == "relevant", "relevant_dropped_at_stage").otherwise("irrelevant_removed")
    return F.when(membership == "included", kept).when(~observed, "relevant_lost_upstream").when(boundary.isNull() | (boundary == "unknown"), "lineage_incomplete").otherwise(gone)


def outcomes(rows: DataFrame) -> DataFrame:
    """Journey rows with their kind and the operator that it counts for."""
    at = F.when(~F.col("observed"), "retrieval_entry").otherwise(F.coalesce("loss_boundary", F.lit("final")))
    return rows.withColumn("kind", outcome(F.col("judgment"), F.col("membership"), F.col("observed"), F.col("loss_boundary"))).withColumn("operator", at)


def losses(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by kind, as a whole and by operator, in one pass."""
    return outcomes(rows).groupingSets([[*keys, "kind"], [*keys, "kind", "operator"]], *keys, "kind", "operator").agg(F.count("*").alias("n"))


def revision_mismatches(before: DataFrame, after: DataFrame) -> DataFrame:
    """chunk, revision of two runs: chunks of both whose sets of revisions differ."""
    each = lambda df, c: df.groupBy("chunk").agg(F.array_sort(F.collect_set("revision")).alias(c))
    return each(before, "b").join(each(after, "a"), "chunk").where("a <> b").select("chunk")


def identity_problems(rows: DataFrame, *scope: str) -> DataFrame:
    """rows: scope, chunk, revision. What can't be an index: a missing revision, or one identity twice."""
    missing = rows.where("chunk is null or revision is null").groupBy(*scope).agg(F.count("*").alias("missing"))
    twice = rows.where("chunk is not null and revision is not null").groupBy(*scope, "chunk", "revision").count().where("count > 1").groupBy(*scope).agg(F.count("*").alias("repeated"))
    return missing.join(twice, list(scope), "full_outer").na.fill(0)


def signatures(spans: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Distinct (op, type, parents) of the graph, with operators renamed by the mapping."""
    pairs = [F.lit(x) for kv in (mapping or {"": ""}).items() for x in kv]
    named = lambda c: F.coalesce(F.try_element_at(F.create_map(*pairs), c), c)
    parents = F.array_join(F.array_sort(F.transform(F.split("parents", ","), named)), ",")
    return spans.select(named(F.col("op_id")).alias("op"), F.col("op_type").alias("type"), parents.alias("parents")).distinct()


def misaligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signatures that only one side has."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))

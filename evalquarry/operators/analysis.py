"""Analyses over traces: branches, gates, scores, latency, ground truth, instrumentation, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.plans.storage import saved


def branches(cands: DataFrame, spans: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per fused span: how many documents all branches share, how many relevant ones the
    branches hold together and the fusion kept. Any judged document counts as relevant."""
    fuse = spans.where("op_type = 'FUSE'").select("trace_id", "query_id", "span_idx")
    c = cands.join(fuse, ["trace_id", "query_id", "span_idx"])
    judged = qrels.select("query_id", "doc_id", F.lit(1).alias("judged"))
    arms = c.where("side = 'in'").groupBy("trace_id", "query_id", "span_idx").agg(F.countDistinct("parent_op_id").alias("n_arms"))
    docs = c.where("side = 'in'").groupBy("trace_id", "query_id", "span_idx", "doc_id").agg(F.countDistinct("parent_op_id").alias("arms"))
    out = c.where("side = 'out'").select("trace_id", "query_id", "span_idx", "doc_id", F.lit(1).alias("fused")).distinct()
    j = docs.join(out, ["trace_id", "query_id", "span_idx", "doc_id"], "full_outer").join(judged, ["query_id", "doc_id"], "left").join(arms, ["trace_id", "query_id", "span_idx"])
    rel = F.col("judged") == 1
    return j.groupBy("trace_id").agg(
        F.count_if(F.col("arms") == F.col("n_arms")).alias("overlap_count"), F.count_if(rel & F.col("arms").isNotNull()).alias("relevant_union"),
        F.count_if(rel & (F.col("fused") == 1)).alias("relevant_fused"), F.count_if(rel & (F.col("arms") == 1)).alias("unique_relevant"),
    ).withColumn("fusion_gain", F.col("relevant_fused") - F.col("relevant_union"))


def gates(spans: DataFrame, final_hits: DataFrame) -> DataFrame:
    """Per route: traffic and how many of its queries' final lists hold a judged document.
    The route is that which was recorded, else the span's status."""
    g = spans.where("op_type = 'GATE'").select("trace_id", F.coalesce("route", "status").alias("route"))
    j = g.join(final_hits.select("trace_id").distinct().withColumn("hit", F.lit(1)), "trace_id", "left")
    return j.groupBy("route").agg(F.count("*").alias("traffic"), F.count("hit").alias("with_relevant")).withColumn("recall", F.col("with_relevant") / F.col("traffic"))


def calibration(scored: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """scored: keys, score, relevant. Equal-width bins with shared edges, half-open but for
    the last: count and share of relevant rows."""
    w = Window.partitionBy(*keys)
    s = scored.withColumn("low", F.min("score").over(w)).withColumn("high", F.max("score").over(w))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("low")) / F.when(width > 0, width))))
    return s.withColumn("bin", at.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(F.col("relevant").cast("int")).alias("relevance_rate"))


def thresholds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score as threshold: how many rows it selects and their precision."""
    per = scored.groupBy(*keys, "score").agg(F.count("*").alias("k"), F.sum(F.col("relevant").cast("int")).alias("r"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*keys, F.col("score").alias("threshold"), F.sum("k").over(w).alias("selected"), (F.sum("r").over(w) / F.sum("k").over(w)).alias("precision"))


def critical_path(spans: DataFrame, order: list[str], parents: dict[str, list[str]]) -> DataFrame:
    """Longest latency path through each trace's graph, one column per operator of the
    topological order: a fold over tens of operators, in one projection."""
    fired = F.when(F.col("status") == "FIRED", F.greatest("latency_ms", F.lit(0.0))).otherwise(0.0)
    wide = spans.groupBy("run_id", "trace_id").agg(*(F.max(F.when(F.col("op_id") == op, fired)).alias(op) for op in order), F.sum(fired).alias("operator_sum"))
    for op in order:
        up = [F.col(p) for p in parents.get(op, [])]
        before = F.greatest(*up) if len(up) > 1 else up[0] if up else F.lit(0.0)
        wide = wide.withColumn(op, F.coalesce(op, F.lit(0.0)) + F.coalesce(before, F.lit(0.0)))
    return wide.select("run_id", "trace_id", F.greatest(*order).alias("critical_path_ms"), "operator_sum")


def ground_truth(judged: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Coverage of judgments: queries without any, judgments of unknown queries or documents."""
    q, d = queries.select("query_id").distinct(), corpus.select("doc_id").distinct()
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(q, "queries"), one(q.join(judged, "query_id", "left_semi"), "judged_queries"), one(judged.join(q, "query_id", "left_anti"), "orphan_queries"), one(judged.join(d, "doc_id", "left_anti"), "orphan_documents"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, F.lit(True))
    return out


def instrumentation(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Operators that are declared, observed or both."""
    j = declared.select("op_id", F.lit(1).alias("d")).distinct().join(observed.select("op_id", F.lit(1).alias("o")).distinct(), "op_id", "full_outer")
    return j.select("op_id", F.when(F.col("o").isNull(), "missing").when(F.col("d").isNull(), "undeclared").otherwise("observed").alias("state"))


def regression_check(value: Column, baseline: Column, kind: str, limit: float) -> Column:
    """Whether a saved check trips: increase, decrease or absolute."""
    return {"increase": value - baseline > limit, "decrease": baseline - value > limit, "absolute": value > limit}[kind]


def lineage_coverage(cands: DataFrame, spans: DataFrame) -> DataFrame:
    """Shares of candidates with ids, of removed ones with a reason, of spans with both sides
    captured; null where there is nothing to count."""
    ids = cands.groupBy("run_id").agg(F.avg(F.col("candidate_id").isNotNull().cast("int")).alias("identity"), F.avg(F.col("doc_id").isNotNull().cast("int")).alias("document_identity"))
    io = spans.where("status = 'FIRED'").groupBy("run_id").agg(F.avg((F.col("output_capture") == "recorded").cast("int")).alias("io"), F.count_if(F.col("output_capture") != "recorded").alias("partial"))
    each = cands.groupBy("run_id", "trace_id", "span_idx", "candidate_id").agg(F.bool_or(F.col("side") == "out").alias("stays"), F.max("reason").alias("reason"))
    exits = each.where("not stays").groupBy("run_id").agg(F.avg(F.col("reason").isNotNull().cast("int")).alias("exit_reason"))
    return ids.join(exits, "run_id", "full_outer").join(io, "run_id", "full_outer")


def topology(spans: DataFrame) -> DataFrame:
    """A hash of each trace's distinct (operator, type, parents, status), and how often it occurs."""
    each = F.concat_ws("|", "op_id", "op_type", F.array_join(F.array_sort(F.split("parents", ",")), ","), "status")
    per = spans.groupBy("run_id", "trace_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(each)), ";"), 256).alias("topology"))
    return per.groupBy("run_id", "topology").agg(F.count("*").alias("traces"))


def graph_nodes(spans: DataFrame) -> DataFrame:
    """Per operator: traces, fire rate, latency; what a drawn pipeline graph shows."""
    fired = F.col("status") == "FIRED"
    return spans.groupBy("run_id", "op_id", "op_type").agg(
        F.count("*").alias("traces"), F.avg(fired.cast("int")).alias("fire_rate"), F.avg(F.when(fired, F.col("latency_ms"))).alias("mean_latency"),
        F.percentile(F.when(fired, F.col("latency_ms")), F.lit(0.95)).alias("p95_latency"),
    )


def graph_edges(spans: DataFrame) -> DataFrame:
    """Per edge: in how many traces its operator fired, and whether it is conditional."""
    e = spans.select("run_id", "op_id", "status", F.explode(F.filter(F.split("parents", ","), lambda p: p != "")).alias("parent"))
    return e.groupBy("run_id", "parent", "op_id").agg(F.count_if(F.col("status") == "FIRED").alias("fired"), F.count("*").alias("traces")).withColumn("conditional", F.col("fired") < F.col("traces"))


def reachable(edges: DataFrame, start: DataFrame, hops: int, edge_type: str | None = None) -> DataFrame:
    """doc_id and the least number of hops from the start documents, up to a bound. Each
    level joins only the last level's new documents and is written to the shared folder, so no
    level is worked out again for the next."""
    e = edges if edge_type is None else edges.where(F.col("edge_type") == edge_type)
    e = e.select("src", "dst")
    seen = saved(start.select("doc_id").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        near = front.join(e, front["doc_id"] == e["src"]).select(F.col("dst").alias("doc_id")).distinct()
        front = saved(near.join(seen, "doc_id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
    return seen


def contract(have: Column, want: Column) -> Column:
    """The state of an analysis and its coverage: ready with all of its evidence, partial with
    some, unavailable (and no coverage of nothing) without."""
    share = F.when(want > 0, have / want)
    return F.struct(F.when((want == 0) | (have == 0), "unavailable").when(have < want, "partial").otherwise("ready").alias("state"), share.alias("coverage"))

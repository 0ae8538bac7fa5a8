"""Evaluating recorded runs: accounting of traces, scoring, diagnosis and projection.

What a run should have recorded is its pipelines times its queries; every trace is
recorded once, belongs to one of these, and is scored by the same rules as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalquarry.operators import diagnostics as D
from evalquarry.operators import journeys as J
from evalquarry.operators import scoring as S
from evalquarry.plans.shipping import ship
from evalquarry.sources.external import attempted
from evalquarry.sources.runstore import RunStore


def schedule(pipelines: DataFrame, queries: DataFrame, seed: int) -> DataFrame:
    """pipelines: pipeline_id; queries: query_id. Every task with an order that mixes the
    pipelines, the same for a seed whatever the partitioning."""
    tasks = queries.select("query_id").crossJoin(F.broadcast(pipelines.select("pipeline_id")))  # a run has a handful of pipelines
    return tasks.withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), "pipeline_id", "query_id")))


def run_tasks(tasks: DataFrame, call: Callable[[str, str], object], tries: int = 2, pause: float = 0.0) -> DataFrame:
    """tasks: pipeline_id, query_id. Status (OK, TIMEOUT, ERROR) and attempts of call(pipeline_id,
    query_id); errors are tried again, timeouts are not."""
    ship(tasks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, times = [], []
            for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, n, error = attempted(lambda p=p, q=q: call(p, q), tries, pause)
                status.append("OK" if error is None else error.split(":", 1)[0])
                times.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(status), pa.array(times, pa.int32())], names=["pipeline_id", "query_id", "status", "attempts"])

    return tasks.select("pipeline_id", "query_id").mapInArrow(run, "pipeline_id string, query_id string, status string, attempts int")


def accounting(expected: DataFrame, traces: DataFrame) -> DataFrame:
    """expected, traces: run_id, query_id (one row a trace). Per run: expected, recorded,
    duplicate, stray and missing (run, query) pairs."""
    keys = ["run_id", "query_id"]
    j = expected.select(*keys).distinct().withColumn("e", F.lit(1)).join(traces.groupBy(*keys).agg(F.count("*").alias("t")), keys, "full_outer")
    return j.groupBy("run_id").agg(
        F.count_if(F.col("e").isNotNull()).alias("expected"), F.coalesce(F.sum("t"), F.lit(0)).alias("recorded"), F.count_if(F.col("t") > 1).alias("duplicates"),
        F.count_if(F.col("e").isNull()).alias("strays"), F.count_if(F.col("t").isNull()).alias("missing"),
    )


def evaluate(spark: SparkSession, folder: str, cands: DataFrame, spans: DataFrame, qrels: DataFrame, corpus: DataFrame, k: int = 10, cutoff: int = 5, digest: str = "d0") -> RunStore:
    """Score, diagnose and project all traces into a store; duplicates, strays and missing traces
    are an error before anything is written."""
    traces = spans.select("run_id", "query_id", "trace_id").distinct()
    runs = traces.select("run_id").distinct()
    expected = runs.crossJoin(traces.select("query_id").distinct())
    wrong = accounting(expected, traces).where("duplicates + strays + missing > 0").collect()
    if wrong:
        raise ValueError(f"traces don't add up: {[r.asDict() for r in wrong]}")
    s = RunStore(spark, folder)
    s.replace("manifests", spans.groupBy("run_id").agg(F.to_json(F.struct(F.countDistinct("query_id").alias("attempted"), F.countDistinct("op_id").alias("operators"))).alias("manifest")))
    wide = S.measures(cands.where("side = 'out'"), qrels, [k], ["run_id", "op_id"], spans=spans.where("status = 'FIRED'"))
    rows = S.quality_rows(wide, [k], ["run_id", "op_id"])
    s.replace("metrics", rows.select("run_id", F.col("op_id").alias("pipeline_id"), "query_id", F.lit(0).alias("stage_index"), "metric_name", "k", "value"))
    s.replace("findings", D.evaluate(D.Context(cands, spans, qrels, corpus, cutoff=cutoff)).join(traces.select("run_id", "trace_id"), "trace_id"))
    pairs = J.journeys(cands, spans, qrels, cutoff)
    s.replace("pairs", pairs)
    s.replace("summaries", summaries(pairs))
    s.append("projections", runs.select("run_id", F.lit(digest).alias("digest"), F.lit("complete").alias("state"), F.lit(1).alias("version")))
    return s


def summaries(pairs: DataFrame) -> DataFrame:
    """Counts of a run's pairs as a whole, by query, by document and by where they were lost."""
    counts = [F.count("*").alias("pairs"), F.count_if(F.col("outcome") == "relevant_delivered").alias("delivered"), F.count_if(F.col("membership") == "excluded").alias("excluded")]
    one = lambda kind, key: pairs.groupBy("run_id", F.lit(kind).alias("kind"), key.alias("key")).agg(*counts)
    parts = one("run", F.lit("")), one("query", F.col("query_id")), one("document", F.col("doc_id")), one("stage", F.coalesce("loss_boundary", F.lit("")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def operator_type(declared: Column, stage: Column) -> Column:
    """Of a stage of a list: as declared, but a fusion at its head is its source; else source first, transform after."""
    return F.when((declared == "FUSE") & (stage == 0), "SOURCE").otherwise(F.coalesce(declared, F.when(stage == 0, "SOURCE").otherwise("TRANSFORM")))


def linear(stages: DataFrame) -> DataFrame:
    """stages: query_id, stage, op_id, doc_id, rank, from 0 without gaps. Each row with the stage
    before as parent and its rank there."""
    before = stages.select("query_id", (F.col("stage") + 1).alias("stage"), F.col("op_id").alias("parent_op_id"), "doc_id", F.col("rank").alias("input_rank"))
    names = before.select("stage", "parent_op_id").distinct()
    return stages.join(names, "stage", "left").join(before.drop("parent_op_id"), ["query_id", "stage", "doc_id"], "left")

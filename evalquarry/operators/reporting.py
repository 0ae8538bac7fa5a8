"""Reports over aggregates: headlines, warnings, contributions, rankings of metric keys.

Aggregates have one row per metric key: pipeline_id, stage_index (-1: the final answer),
metric_name, k, branch_id, mean, n and what else a report shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quality metrics in the order that reports list them.
QUALITY = ("recall", "ndcg", "precision", "mrr", "map")


def quality_rank(metric: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(m) for m in QUALITY)), metric), F.lit(0)).cast("int")


def operational(metric: Column) -> Column:
    return metric.rlike("^(latency|cost)")


def final_stage(aggregates: DataFrame) -> DataFrame:
    """Per pipeline the stage of its final answer: -1, else the deepest that isn't a branch."""
    q = aggregates.where(quality_rank(F.col("metric_name")) > 0)
    spine = F.max(F.when(F.col("branch_id").isNull(), F.col("stage_index")))
    return q.groupBy("pipeline_id").agg(F.when(F.min("stage_index") == -1, F.lit(-1)).otherwise(F.coalesce(spine, F.max("stage_index"))).alias("final_stage"))


def headline(aggregates: DataFrame, per_pipeline: int = 3, total: int = 6, costs: int = 2) -> DataFrame:
    """Few numbers of a run: of each pipeline's final answer the largest k of a metric, then
    what it costs. One row per metric key goes in, a page's worth comes out."""
    rank = quality_rank(F.col("metric_name"))
    at = aggregates.join(final_stage(aggregates), "pipeline_id")
    top = at.where((rank > 0) & (F.col("stage_index") == F.col("final_stage"))).groupBy("pipeline_id", "metric_name").agg(F.max(F.struct("k", "mean", "n")).alias("b"))
    own = Window.partitionBy("pipeline_id").orderBy(rank)
    chosen = top.withColumn("r", F.row_number().over(own)).where(F.col("r") <= per_pipeline).orderBy("pipeline_id", "r").limit(total)
    quality = chosen.select("pipeline_id", "metric_name", "b.k", "b.mean", F.lit("quality").alias("kind"))
    dear = aggregates.where(operational(F.col("metric_name"))).orderBy(F.col("stage_index") != -1, "pipeline_id", "stage_index", "metric_name", "k").limit(costs)
    return quality.unionByName(dear.select("pipeline_id", "metric_name", "k", "mean", F.lit("operational").alias("kind")))


def winner(aggregates: DataFrame) -> DataFrame:
    """The pipeline with the best final ndcg@10; of equal ones that with the better recall@10."""
    at = aggregates.join(final_stage(aggregates), "pipeline_id").where((F.col("stage_index") == F.col("final_stage")) & F.col("branch_id").isNull() & (F.col("k") == 10))
    both = at.groupBy("pipeline_id").agg(F.max(F.when(F.col("metric_name") == "ndcg", F.col("mean"))).alias("ndcg"), F.max(F.when(F.col("metric_name") == "recall", F.col("mean"))).alias("recall"))
    return both.where("ndcg is not null").orderBy(F.desc("ndcg"), F.desc("recall"), "pipeline_id").limit(1)


def warnings(aggregates: DataFrame, zero_pct: float = 20.0, least: int = 30) -> DataFrame:
    """What a reader should know: many zeros, wide intervals (low, high) of enough values."""
    wide = (F.col("high") - F.col("low")) / F.greatest(F.abs("mean"), F.lit(0.001))
    sparse = ((F.col("high") - F.col("low")) >= 0.05) & (F.abs("mean") < 0.2)
    kinds = F.array_compact(F.array(F.when(F.col("zero_pct") > zero_pct, "zeros"), F.when((F.col("n") >= least) & ((wide >= 0.35) | sparse), "wide_interval")))
    return aggregates.where((quality_rank(F.col("metric_name")) > 0) & F.col("branch_id").isNull()).select("pipeline_id", "stage_index", "metric_name", "k", F.explode(kinds).alias("warning"))


def ranked_keys(aggregates: DataFrame, guarded: list[tuple[str, int]] = []) -> DataFrame:  # noqa: B006
    """Metric keys of each pipeline by what they say about a release: guarded ones (metric, k), the
    final answer's quality, the funnel from its end, the rest."""
    rank = quality_rank(F.col("metric_name"))
    is_guarded = F.lit(False)
    for metric, k in guarded:
        is_guarded = is_guarded | ((F.col("metric_name") == metric) & (F.col("k") == k) & (F.col("stage_index") == F.col("final_stage")))
    tier = F.when(is_guarded, 0).when((rank > 0) & F.col("branch_id").isNull() & (F.col("stage_index") == F.col("final_stage")), 1).when(rank > 0, 2).otherwise(3)
    at = aggregates.join(final_stage(aggregates), "pipeline_id", "left").withColumn("tier", tier)
    order = ["tier", F.when(F.col("tier") == 2, -F.col("stage_index")).otherwise(0), F.col("branch_id").isNotNull(), F.when(rank > 0, rank).otherwise(99), "k", "metric_name", "stage_index", F.coalesce("branch_id", F.lit(""))]
    return at.withColumn("place", F.row_number().over(Window.partitionBy("pipeline_id").orderBy(*order)))


def one_latency(keys: DataFrame) -> DataFrame:
    """keys: key, pos. Percentile keys of one latency become its mean, at the first of their places."""
    mean = F.regexp_replace("key", r"\|latency_(?:ms|p\d+)@", "|latency_mean@")
    return keys.groupBy(mean.alias("key")).agg(F.min("pos").alias("pos"))


def primary(keys: DataFrame) -> DataFrame:
    """keys: metric_name, k, key, paired. The metric of a comparison's tables: ndcg before recall,
    the largest k, with a query that both runs scored."""
    some = keys.where(F.col("metric_name").isin("ndcg", "recall") & (F.col("paired") > 0))
    return some.orderBy(F.desc(F.col("metric_name") == "ndcg"), F.desc("k"), F.desc("key")).limit(1)


def contributions(values: DataFrame, order: dict[str, int]) -> DataFrame:
    """values: run_id, op_id, query_id, value. What each step of the spine adds to the one
    before: pairs by query, mean difference, how many queries gain and lose."""
    place = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    v = values.where(F.col("op_id").isin(list(order))).withColumn("at", F.element_at(place, F.col("op_id")))
    a, b = v.alias("a"), v.alias("b")
    j = b.join(a, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.at") == F.col("b.at") - 1))
    delta = F.col("b.value") - F.col("a.value")
    return j.groupBy(F.col("b.run_id").alias("run_id"), F.col("a.op_id").alias("before_op"), F.col("b.op_id").alias("after_op")).agg(
        F.count("*").alias("n"), F.avg(delta).alias("delta"), F.count_if(delta > 0).alias("gained"), F.count_if(delta < 0).alias("lost"))


def overlaps(points: DataFrame) -> DataFrame:
    """points: id, low, high, one row per pipeline. Which intervals meet."""
    a, b = points.alias("a"), F.broadcast(points.alias("b"))
    return a.join(b, F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), ((F.col("a.low") <= F.col("b.high")) & (F.col("b.low") <= F.col("a.high"))).alias("overlap"))


def rerank_mode(recall_gain: Column, ndcg_gain: Column, least: float = 0.001) -> Column:
    """What a reranker does: find more, order better, or neither."""
    return F.when(recall_gain > least, "recovery").when(ndcg_gain > least, "reordering").otherwise("no_gain")


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a Markdown table."""
    cells = [x for c in columns for x in (F.col(c).cast("string"), F.lit(" | "))][:-1]
    return rows.select(F.concat(F.lit("| "), *cells, F.lit(" |")).alias("line"))


def label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def metric_label(key: Column) -> Column:
    """@0 stands for no cut-off: whole lists, where the metric has one."""
    short = F.regexp_replace(key, "@0$", "")
    return F.when(~key.endswith("@0"), key).when(short.rlike("(^|\\|)(mrr|map)$"), F.concat(short, F.lit(" (whole list)"))).otherwise(short)


def cost_per_1k(stages: DataFrame, costs: DataFrame) -> DataFrame:
    """stages: pipeline_id, op_id, op_type; costs: name, per_1k. A stage's cost is that of its id,
    else of its type, else nothing."""
    c = F.broadcast(costs)  # a price list
    by_id = stages.join(c.select(F.col("name").alias("op_id"), F.col("per_1k").alias("own")), "op_id", "left")
    both = by_id.join(c.select(F.col("name").alias("op_type"), F.col("per_1k").alias("kind")), "op_type", "left")
    return both.groupBy("pipeline_id").agg(F.sum(F.coalesce("own", "kind", F.lit(0.0))).alias("per_1k"))

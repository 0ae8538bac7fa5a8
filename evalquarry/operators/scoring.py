"""Ranking metrics in row form: ranked lists joined with judgments, for every key at once.

Lists: keys, query_id, doc_id, rank. Judgments: query_id, doc_id, grade (relevant above 0).
Queries without a relevant judgment give no row; a list without candidates scores 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduped(lists: DataFrame, *keys: str) -> DataFrame:
    """The first occurrence of each document, ranked anew without gaps."""
    first = lists.groupBy(*keys, "query_id", "doc_id").agg(F.min("rank").alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "query_id").orderBy("at", "doc_id"))).drop("at")


def ideal(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: n_rel and the ideal discounted gains, binary and graded, at each k."""
    place = Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    r = qrels.where("grade > 0").withColumn("i", F.row_number().over(place))
    gain = 1.0 / F.log2(F.col("i") + 1.0)
    return r.groupBy("query_id").agg(
        F.count("*").alias("n_rel"),
        *(F.sum(F.when(F.col("i") <= k, gain)).alias(f"ideal_{k}") for k in ks),
        *(F.sum(F.when(F.col("i") <= k, gain * F.col("grade"))).alias(f"ideal_graded_{k}") for k in ks),
    )


def measures(lists: DataFrame, qrels: DataFrame, ks: list[int], keys: list[str], spans: DataFrame | None = None) -> DataFrame:
    """One row per keys and query with recall_k, precision_k, ndcg_k, ndcg_graded_k, mrr and
    ap. spans (keys, query_id): lists that count even if empty."""
    judged = deduped(lists, *keys).join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    rel = F.coalesce(F.col("grade"), F.lit(0)) > 0
    so_far = F.sum(rel.cast("int")).over(Window.partitionBy(*keys, "query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    gain = 1.0 / F.log2(F.col("rank") + 1.0)
    top = lambda k, value: F.sum(F.when((F.col("rank") <= k) & rel, value).otherwise(0.0))
    got = judged.withColumn("so_far", so_far).groupBy(*keys, "query_id").agg(
        *(top(k, 1.0).alias(f"hits_{k}") for k in ks), *(top(k, gain).alias(f"dcg_{k}") for k in ks), *(top(k, gain * F.col("grade")).alias(f"dcg_graded_{k}") for k in ks),
        F.min(F.when(rel, F.col("rank"))).alias("first"), F.sum(F.when(rel, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    if spans is not None:
        got = spans.select(*keys, "query_id").distinct().join(got, [*keys, "query_id"], "left").na.fill(0)
        got = got.withColumn("first", F.nullif(F.col("first"), F.lit(0)))
    out = got.join(ideal(qrels, ks), "query_id")
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    return out.select(
        *keys, "query_id", "n_rel",
        *(ratio(f"hits_{k}", "n_rel").alias(f"recall_{k}") for k in ks), *((F.col(f"hits_{k}") / k).alias(f"precision_{k}") for k in ks),
        *(ratio(f"dcg_{k}", f"ideal_{k}").alias(f"ndcg_{k}") for k in ks), *(ratio(f"dcg_graded_{k}", f"ideal_graded_{k}").alias(f"ndcg_graded_{k}") for k in ks),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), ratio("ap_sum", "n_rel").alias("ap"),
    )


def quality_rows(wide: DataFrame, ks: list[int], keys: list[str], graded: bool = True) -> DataFrame:
    """The wide rows as (keys, query_id, metric_name, k, value); k is 0 where a metric has none."""
    name = "ndcg_graded" if graded else "ndcg"
    cells = [F.struct(F.lit(m).alias("metric_name"), F.lit(k).alias("k"), F.col(f"{c}_{k}").alias("value")) for k in ks for m, c in (("recall", "recall"), ("precision", "precision"), ("ndcg", name))]
    cells += [F.struct(F.lit(m).alias("metric_name"), F.lit(0).alias("k"), F.col(c).alias("value")) for m, c in (("mrr", "mrr"), ("map", "ap"))]
    return wide.select(*keys, "query_id", F.explode(F.array(*cells)).alias("m")).select(*keys, "query_id", "m.*")


def decay(distance: Column, period: float, kind: str = "exp", rate: float = 1.0) -> Column:
    """Weight of a time distance in the unit of the period; without a distance 1."""
    share = distance / period
    weight = {"exp": F.exp(-rate * share), "linear": F.greatest(F.lit(0.0), 1 - share), "step": F.when(share <= 1, 1.0).otherwise(0.0)}[kind]
    return F.coalesce(weight, F.lit(1.0))


def temporal_recall(lists: DataFrame, relevant: DataFrame, k: int, period: float, kind: str = "exp", rate: float = 1.0) -> DataFrame:
    """relevant: query_id, doc_id, distance (null: unknown). Share of the relevant documents'
    weights that the first k hold."""
    weighed = relevant.withColumn("weight", decay(F.col("distance"), period, kind, rate))
    hit = deduped(lists).where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("hit"))
    each = weighed.join(hit, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0.0)).alias("got"), F.sum("weight").alias("all"))
    return each.select("query_id", F.coalesce(F.col("got") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("temporal_recall"))


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one value), number, zeros and their share of value."""
    return rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.count("*").alias("n"),
        F.count_if(F.col("value") == 0).alias("zero_count"), F.round(100.0 * F.count_if(F.col("value") == 0) / F.count("*"), 1).alias("zero_pct"),
    )


def percentiles(rows: DataFrame, keys: list[str], column: str, points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Exact percentiles by linear interpolation; 0 where there is no value."""
    each = [F.coalesce(F.percentile(column, F.lit(p / 100)), F.lit(0.0)).alias(f"p{p}") for p in points]
    return rows.groupBy(*keys).agg(*each, F.count(column).alias("n")) if keys else rows.agg(*each, F.count(column).alias("n"))

"""Comparison of two runs on their metric facts.

A metric fact has one row per (run_id, pipeline_id, query_id, stage_index, metric_name, k,
branch_id): value. Two runs are paired by query and key; a null branch equals a null branch.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.plans.shipping import ship

KEY = ["pipeline_id", "stage_index", "metric_name", "k"]


def of_run(metrics: DataFrame, run: str) -> DataFrame:
    return metrics.where(F.col("run_id") == run)


def paired(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Inner join by key and query: before, after, delta."""
    on = [*KEY, "query_id"]
    return base.select(*on, F.col("value").alias("before")).join(cand.select(*on, F.col("value").alias("after")), on).withColumn("delta", F.col("after") - F.col("before"))


def coverage(base: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: attempted on either side, paired, missing on one side. One row per
    (keys, query_id) and side is assumed."""
    on = [*keys, "query_id"]
    j = base.select(*on).distinct().withColumn("b", F.lit(1)).join(cand.select(*on).distinct().withColumn("a", F.lit(1)), on, "full_outer")
    out = j.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("paired"),
        F.count_if(F.col("b").isNull()).alias("missing_base"), F.count_if(F.col("a").isNull()).alias("missing_cand"),
    )
    return out.withColumn("coverage", F.col("paired") / F.col("attempted"))


def failed_queries(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("metric_name").isin("failure", "timeout") & (F.col("value") > 0)).select("query_id").distinct()


def lower_is_better(metric: Column) -> Column:
    return metric.rlike("^(latency|cost|profile|failure|timeout|dropout)")


def effect_threshold(metric: Column, base_mean: Column) -> Column:
    """What difference counts: 1 or 5% for latencies, 0.001 or 5% for costs, else 0.01."""
    five = F.abs(base_mean) * 0.05
    return F.when(metric.rlike("^(latency|profile)"), F.greatest(F.lit(1.0), five)).when(metric.startswith("cost"), F.greatest(F.lit(0.001), five)).otherwise(F.lit(0.01))


def benjamini_hochberg(tests: DataFrame, p: str, order: str) -> DataFrame:
    """Adds q: the step-up adjusted p-values of all rows (one row per test)."""
    up = Window.orderBy(p, order)
    ranked = tests.withColumn("r", F.row_number().over(up)).withColumn("m", F.count("*").over(Window.partitionBy()))
    down = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.min(F.least(F.col(p) * F.col("m") / F.col("r"), F.lit(1.0))).over(down)).drop("r", "m")


def sign_flip_p(before: list[float], after: list[float], resamples: int = 1000, seed: int = 42) -> float:
    """Two-sided paired sign-flip test, (extreme + 1) / (resamples + 1). The draws depend on
    the order of the pairs, which is that of the queries."""
    n = len(before)
    if not n:
        return 1.0
    seen = abs(sum(before) / n - sum(after) / n)
    if seen == 0:
        return 1.0
    deltas = np.subtract(before, after, dtype=float)
    doubt = 4 * np.finfo(float).eps * np.abs(deltas).sum()  # a mean so close to the seen one is summed again as Python does
    extreme = 0
    for signs in _signs(n, resamples, seed):
        means = np.abs(signs @ deltas) / n
        close = np.abs(means - seen) <= doubt
        extreme += int(np.count_nonzero((means >= seen) & ~close))
        extreme += sum(abs(sum((deltas * row).tolist()) / n) >= seen for row in signs[close])
    return (extreme + 1) / (resamples + 1)


def _signs(n: int, draws: int, seed: int, block: int = 1 << 20) -> Iterator[np.ndarray]:
    """The draws of random.Random(seed).choice((-1.0, 1.0)) in rows of n, some rows at a
    time: the top two bits of a word of the generator, below 2."""
    _, state, _ = random.Random(seed).getstate()
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    left, rows = np.empty(0), max(1, block // n)
    for at in range(0, draws, rows):
        need = min(rows, draws - at) * n
        parts = [left]
        have = len(left)
        while have < need:
            top = words.random_raw(2 * (need - have) + 64) >> 30
            parts.append(np.where(top[top < 2] == 1, 1.0, -1.0))
            have += len(parts[-1])
        signs = np.concatenate(parts)
        left = signs[need:]
        yield signs[:need].reshape(-1, n)


def quantile(values: list[float], q: float) -> float:
    """By linear interpolation; 0 without values."""
    if not values:
        return 0.0
    v = sorted(values)
    at = min(max(q, 0.0), 1.0) * (len(v) - 1)
    i = int(at)
    return v[i] if i + 1 == len(v) else v[i] * (1 - (at - i)) + v[i + 1] * (at - i)


def bootstrap_ci(values: list[float], resamples: int = 1000, level: float = 0.95, seed: int = 42) -> tuple[float, float]:
    """Percentile bootstrap of the mean; (0, 0) without values."""
    if not values:
        return 0.0, 0.0
    draw, n = random.Random(seed).choice, len(values)
    means = [sum([draw(values) for _ in range(n)]) / n for _ in range(resamples)]
    return quantile(means, (1 - level) / 2), quantile(means, (1 + level) / 2)


def effect_ci(before: list[float], after: list[float], resamples: int = 1000, level: float = 0.95, seed: int = 42, estimator: str = "mean") -> tuple[float | None, float | None, float | None]:
    """(effect, low, high) of after - before by resampling pairs; nulls without pairs.
    estimator: mean, p50, p95 or p99."""
    a, b = np.asarray(after, float), np.asarray(before, float)
    if not len(a):
        return None, None, None
    point = np.mean if estimator == "mean" else lambda x: np.quantile(x, float(estimator[1:]) / 100)
    rng = np.random.default_rng(seed)
    draws = [point(a[i]) - point(b[i]) for i in (rng.integers(0, len(b), size=len(b)) for _ in range(resamples))]
    low, high = np.quantile(draws, [(1 - level) / 2, 1 - (1 - level) / 2])
    return float(point(a) - point(b)), float(low), float(high)


def resampled(pairs: DataFrame, keys: list[str], resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """p value and interval of each key's pairs, whose number is that of the queries."""
    ship(pairs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("query_id")
        before, after = g["before"].tolist(), g["after"].tolist()
        effect, low, high = effect_ci(before, after, resamples, level, seed)
        return pd.DataFrame([{**{k: g[k].iloc[0] for k in keys}, "p_value": sign_flip_p(before, after, resamples, seed), "effect": effect, "low": low, "high": high}])

    return pairs.select(*keys, "query_id", "before", "after").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", p_value double, effect double, low double, high double")


def normal_p(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The large-sample paired test, in one aggregation for any number of queries: mean
    difference, its standard error, z and a two-sided logistic approximation of p."""
    n = F.count("*")
    s = pairs.groupBy(*keys).agg(n.alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg("delta").alias("effect"), (F.stddev_samp("delta") / F.sqrt(n)).alias("se"))
    z = F.when(F.col("se") > 0, F.abs(F.col("effect")) / F.col("se")).otherwise(F.lit(0.0))
    return s.withColumn("z", z).withColumn("p", 2 / (1 + F.exp(1.5976 * F.col("z") + 0.070565992 * F.pow("z", F.lit(3)))))


def decisions(tests: DataFrame, alpha: float = 0.05, min_power: int = 20, min_coverage: float = 0.95) -> DataFrame:
    """tests: metric_name, mean_before, effect, q, n, coverage. Adds threshold, reason and
    decision: candidate_better, candidate_worse or no_decision."""
    need = effect_threshold(F.col("metric_name"), F.col("mean_before"))
    better = F.when(lower_is_better(F.col("metric_name")), F.col("effect") < 0).otherwise(F.col("effect") > 0)
    reason = (
        F.when(F.col("n") < min_power, "insufficient_pairs").when(F.col("coverage") < min_coverage, "pair_coverage")
        .when(F.col("q") >= alpha, "not_significant").when(F.abs("effect") < F.col("threshold"), "below_threshold").otherwise("significant")
    )
    decision = F.when(F.col("reason") != "significant", "no_decision").when(better, "candidate_better").otherwise("candidate_worse")
    return tests.withColumn("threshold", need).withColumn("reason", reason).withColumn("decision", decision)


def compared(base: DataFrame, cand: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Per key: n, means, effect, sign-flip p, q over all keys, coverage, threshold, reason and decision."""
    pairs = paired(base, cand)
    means = pairs.groupBy(*KEY).agg(F.count("*").alias("n"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.avg("delta").alias("effect"))
    p = resampled(pairs, KEY, resamples, seed).select(*KEY, F.col("p_value").alias("p"))
    tests = means.join(p, KEY).join(coverage(base, cand, KEY).select(*KEY, "coverage"), KEY).withColumn("key", F.concat_ws("|", *KEY))
    return decisions(benjamini_hochberg(tests, "p", "key")).drop("key")


def effects(pairs: DataFrame, keys: list[str], estimators: tuple[str, ...] = ("mean", "p50", "p95"), resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Effect and interval of each estimator by resampling pairs; a key's pairs, as many as a run
    has queries, are one group."""
    ship(pairs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("query_id")
        out = []
        for e in estimators:
            effect, low, high = effect_ci(g["before"].tolist(), g["after"].tolist(), resamples, level, seed, e)
            out.append({**{k: g[k].iloc[0] for k in keys}, "estimator": e, "effect": effect, "low": low, "high": high})
        return pd.DataFrame(out)

    return pairs.select(*keys, "query_id", "before", "after").groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", estimator string, effect double, low double, high double")


def poisson_bootstrap(rows: DataFrame, keys: list[str], resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """rows: keys, query_id, value, in any number. Mean and interval of a bootstrap whose draws
    are Poisson weights hashed from query and resample: every task sums its own rows for all
    resamples, so a group of any size is split, and the result depends on no partitioning but
    for the order of floating-point sums."""
    ship(rows.sparkSession)
    cdf = np.cumsum([np.exp(-1) / math.factorial(i) for i in range(12)])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    salts = np.random.default_rng(seed).integers(0, 1 << 63, resamples, dtype=np.int64).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, g in batch.groupby(keys, dropna=False):
                total = sums.setdefault(key, np.zeros((2, resamples)))
                h, v = g["h"].to_numpy(np.int64).view(np.uint64), g["value"].to_numpy(float)
                for lo in range(0, len(h), 512):
                    with np.errstate(over="ignore"):
                        x = h[lo : lo + 512, None] ^ salts[None, :]
                        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                        x ^= x >> np.uint64(31)
                    w = np.searchsorted(cdf, (x >> np.uint64(11)).astype(float) / 2.0**53)
                    total[0] += w.sum(0)
                    total[1] += v[lo : lo + 512] @ w
        for key, total in sums.items():
            yield pd.DataFrame([{**dict(zip(keys, key, strict=True)), "w": total[0].tolist(), "s": total[1].tolist()}])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", w array<double>, s array<double>"
    parts = rows.select(*keys, F.xxhash64("query_id").alias("h"), F.col("value").cast("double")).mapInPandas(run, schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("w", "s")).alias("r", "z")).groupBy(*keys, "r").agg(F.sum("z.w").alias("w"), F.sum("z.s").alias("s")).withColumn("m", F.try_divide("s", "w"))
    ends = each.groupBy(*keys).agg(F.percentile("m", F.lit((1 - level) / 2)).alias("low"), F.percentile("m", F.lit((1 + level) / 2)).alias("high"))
    return rows.groupBy(*keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).join(ends, keys)


def interval_status(low: Column, high: Column, margin: Column, lower_better: Column) -> Column:
    """Non-inferiority: the worst end of the interval against the margin."""
    worst, best = F.when(lower_better, -high).otherwise(low), F.when(lower_better, -low).otherwise(high)
    return F.when(worst >= -margin, "PASS").when(best < -margin, "FAIL").otherwise("HOLD")


def prefix_pairs(pipelines: DataFrame) -> DataFrame:
    """(parent, child) where a pipeline's id is the other's plus one '__' part."""
    parts = F.split("pipeline_id", "__")
    child = pipelines.select(F.col("pipeline_id").alias("child"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "__").alias("pipeline_id"), F.size(parts).alias("n"))
    return child.where("n > 1").join(pipelines, "pipeline_id").select(F.col("pipeline_id").alias("parent"), "child")


def query_diffs(pairs: DataFrame, top: int = 50) -> DataFrame:
    """The queries with the largest differences."""
    return pairs.orderBy(F.desc(F.abs("delta")), *KEY, "query_id").limit(top)


def affected_queries(pairs: DataFrame, keys: list[str], top: int = 20) -> DataFrame:
    """Per key the queries that got worst, worst first."""
    bad = F.when(lower_is_better(F.col("metric_name")), -F.col("delta")).otherwise(F.col("delta"))
    w = Window.partitionBy(*keys).orderBy("bad", "query_id")
    return pairs.withColumn("bad", bad).where("bad < 0").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def pareto(points: DataFrame, up: str, down: str) -> DataFrame:
    """Points (id) that no other beats in one measure without losing in the other: a sweep
    over descending `up`, not a join of all pairs."""
    per = points.groupBy(up).agg(F.min(down).alias("least"))
    ahead = per.withColumn("before", F.min("least").over(Window.orderBy(F.desc(up)).rowsBetween(Window.unboundedPreceding, -1)))
    j = points.join(ahead, up)
    return j.where((F.col(down) == F.col("least")) & (F.col("before").isNull() | (F.col(down) < F.col("before")))).drop("least", "before")

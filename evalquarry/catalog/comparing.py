"""Queries of run comparison and stored metrics (binding M), and of release checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.operators import comparison as C
from evalquarry.operators import scoring as S
from evalquarry.registry import on

KEY = C.KEY


def _runs(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    m = ev("metrics")
    return C.of_run(m, "base"), C.of_run(m, "cand")


_PAIRS = """, pr AS (SELECT b.pipeline_id, b.stage_index, b.metric_name, b.k, b.query_id, b.value AS before, a.value AS after, a.value - b.value AS delta
FROM metrics b JOIN metrics a ON a.run_id = 'cand' AND b.run_id = 'base' AND a.pipeline_id = b.pipeline_id AND a.stage_index = b.stage_index AND a.query_id = b.query_id)"""


@on("M", f"{_PAIRS} SELECT pipeline_id, stage_index, metric_name, k, count(*) AS n, round(avg(before), 6) AS mean_before, round(avg(after), 6) AS mean_after, round(avg(delta), 6) AS effect FROM pr GROUP BY 1, 2, 3, 4")
def J01_paired_join(ev: Evidence) -> DataFrame:
    r = lambda c: F.round(F.avg(c), 6)
    return C.paired(*_runs(ev)).groupBy(*KEY).agg(F.count("*").alias("n"), r("before").alias("mean_before"), r("after").alias("mean_after"), r("delta").alias("effect"))


@on("M", "SELECT pipeline_id, stage_index, query_id, value FROM metrics WHERE run_id = 'base'")
def J02_scores_by_query(ev: Evidence) -> DataFrame:
    """Of every key the value of each query; of rows that repeat one the last stays."""
    rows = _runs(ev)[0].withColumn("seq", F.lit(1))
    return rows.unionByName(rows.withColumns({"seq": F.lit(0), "value": F.lit(9.0)})).groupBy(*KEY, "query_id").agg(F.max_by("value", "seq").alias("value")).select("pipeline_id", "stage_index", "query_id", "value")


@on("M", """SELECT pipeline_id, stage_index, metric_name, k, count(DISTINCT query_id) AS attempted, count(DISTINCT query_id) FILTER (run_id = 'cand') AS paired, 0 AS missing_base,
  count(DISTINCT query_id) - count(DISTINCT query_id) FILTER (run_id = 'cand') AS missing_cand, round(count(DISTINCT query_id) FILTER (run_id = 'cand') * 1e0 / count(DISTINCT query_id), 6) AS coverage FROM metrics GROUP BY 1, 2, 3, 4""")  # fmt: skip
def J03_pair_coverage(ev: Evidence) -> DataFrame:
    return C.coverage(*_runs(ev), KEY).withColumn("coverage", F.round("coverage", 6))


@on("M", "SELECT DISTINCT query_id FROM metrics b WHERE run_id = 'base' AND NOT EXISTS (SELECT 1 FROM metrics c WHERE c.run_id = 'cand' AND c.query_id = b.query_id)")
def J04_failed_queries(ev: Evidence) -> DataFrame:
    """Indicators: 1 for a query of the base run that the candidate has no value of."""
    base, cand = (m.select("query_id").distinct() for m in _runs(ev))
    ind = base.join(cand.withColumn("there", F.lit(1)), "query_id", "left").select("query_id", F.lit("failure").alias("metric_name"), F.when(F.col("there").isNull(), 1.0).otherwise(0.0).alias("value"))
    return C.failed_queries(ind)


@on("M", """, ids AS (SELECT DISTINCT pipeline_id || CASE WHEN stage_index <= 1 THEN '' WHEN stage_index = 2 THEN '__2' ELSE '__2__' || stage_index END AS id FROM metrics)
SELECT p.id AS parent, c.id AS child FROM ids c JOIN ids p ON length(c.id) > length(p.id) AND starts_with(c.id, p.id || '__') AND NOT contains(substr(c.id, length(p.id) + 3), '__')""")
def J05_prefix_pairs(ev: Evidence) -> DataFrame:
    stage = F.col("stage_index")
    name = F.concat("pipeline_id", F.when(stage <= 1, "").when(stage == 2, "__2").otherwise(F.concat(F.lit("__2__"), stage.cast("string"))))
    return C.prefix_pairs(ev("metrics").select(name.alias("pipeline_id")).distinct())


@on("M", f"{_PAIRS} SELECT pipeline_id, stage_index, query_id, round(delta, 6) AS delta FROM pr ORDER BY abs(delta) DESC, pipeline_id, stage_index, metric_name, k, query_id LIMIT 50")
def J06_query_diffs(ev: Evidence) -> DataFrame:
    return C.query_diffs(C.paired(*_runs(ev))).select("pipeline_id", "stage_index", "query_id", F.round("delta", 6).alias("delta"))


_TESTS = f"""{_PAIRS}, st AS (SELECT pipeline_id, stage_index, metric_name, k, count(*) AS n, avg(before) AS mean_before, avg(delta) AS effect, stddev_samp(delta) / sqrt(count(*)) AS se FROM pr GROUP BY 1, 2, 3, 4),
ts AS (SELECT *, CASE WHEN se > 0 THEN abs(effect) / se ELSE 0 END AS z FROM st), tp AS (SELECT *, round(2 / (1 + exp(1.5976 * z + 0.070565992 * z * z * z)), 9) AS p FROM ts),
rk AS (SELECT *, row_number() OVER (ORDER BY p, concat(pipeline_id, '|', stage_index)) AS r, count(*) OVER () AS m FROM tp),
bh AS (SELECT *, min(least(p * m / r, 1)) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING) AS q FROM rk),
cv AS (SELECT pipeline_id, stage_index, count(DISTINCT query_id) FILTER (run_id = 'cand') * 1e0 / count(DISTINCT query_id) AS coverage FROM metrics GROUP BY 1, 2)"""


def _tests(ev: Evidence) -> DataFrame:
    t = C.normal_p(C.paired(*_runs(ev)), KEY)
    t = t.withColumn("p", F.round("p", 9)).withColumn("key", F.concat_ws("|", "pipeline_id", "stage_index"))
    return C.benjamini_hochberg(t, "p", "key")


@on("M", f"{_TESTS} SELECT pipeline_id, stage_index, round(p, 6) AS p, round(q, 6) AS q FROM bh")
def P01_bh_correction(ev: Evidence) -> DataFrame:
    return _tests(ev).select("pipeline_id", "stage_index", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@on("M", f"""{_TESTS}, dc AS (SELECT bh.pipeline_id, bh.stage_index, n, round(mean_before, 6) AS mean_before, round(effect, 6) AS effect, 0.01 AS threshold, round(q, 6) AS q,
  CASE WHEN n < 20 THEN 'insufficient_pairs' WHEN coverage < 0.95 THEN 'pair_coverage' WHEN q >= 0.05 THEN 'not_significant' WHEN abs(effect) < 0.01 THEN 'below_threshold' ELSE 'significant' END AS reason, effect AS e FROM bh JOIN cv USING (pipeline_id, stage_index))
SELECT pipeline_id, stage_index, n, mean_before, effect, threshold, q, reason, CASE WHEN reason <> 'significant' THEN 'no_decision' WHEN e > 0 THEN 'candidate_better' ELSE 'candidate_worse' END AS decision FROM dc""")  # fmt: skip
def P06_large_sample_comparison(ev: Evidence) -> DataFrame:
    """The approximation for runs too large to resample: a normal test in one aggregation."""
    t = _tests(ev).join(C.coverage(*_runs(ev), KEY).select(*KEY, "coverage"), KEY)
    out = C.decisions(t)
    return out.select("pipeline_id", "stage_index", "n", *(F.round(c, 6).alias(c) for c in ("mean_before", "effect", "threshold", "q")), "reason", "decision")


@on("M", f"""{_TESTS} SELECT pipeline_id, stage_index, CASE WHEN effect - 1.96 * se >= -0.02 THEN 'PASS' WHEN effect + 1.96 * se < -0.02 THEN 'FAIL' ELSE 'HOLD' END AS status FROM bh""")
def P07_large_sample_guards(ev: Evidence) -> DataFrame:
    """Guards on normal intervals, the approximation for large runs."""
    low, high = F.col("effect") - 1.96 * F.col("se"), F.col("effect") + 1.96 * F.col("se")
    return _tests(ev).select("pipeline_id", "stage_index", C.interval_status(low, high, F.lit(0.02), C.lower_is_better(F.col("metric_name"))).alias("status"))


@on("M")
def P03_sign_flip_test(ev: Evidence) -> DataFrame:
    return C.resampled(C.paired(*_runs(ev)), KEY)


@on("M")
def P06_paired_comparison(ev: Evidence) -> DataFrame:
    """Sign-flip p-values, corrected over all keys, and the ladder of decisions."""
    return C.compared(*_runs(ev))


@on("M")
def P07_guard_intervals(ev: Evidence) -> DataFrame:
    """Guards on the interval of the paired bootstrap."""
    r = C.resampled(C.paired(*_runs(ev)), KEY)
    return r.select("pipeline_id", "stage_index", C.interval_status(F.col("low"), F.col("high"), F.lit(0.02), C.lower_is_better(F.col("metric_name"))).alias("status"))


@on("M", f"""{_PAIRS} SELECT pipeline_id, stage_index, query_id, place, round(delta, 6) AS delta FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, stage_index ORDER BY delta, query_id) AS place FROM pr WHERE delta < 0) WHERE place <= 20""")
def W13_affected_queries(ev: Evidence) -> DataFrame:
    return C.affected_queries(C.paired(*_runs(ev)), ["pipeline_id", "stage_index"]).select("pipeline_id", "stage_index", "query_id", "place", F.round("delta", 6).alias("delta"))


@on("M", "SELECT run_id, pipeline_id, stage_index, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(*) AS n FROM metrics GROUP BY 1, 2, 3")
def F11_percentiles(ev: Evidence) -> DataFrame:
    p = S.percentiles(ev("metrics"), ["run_id", "pipeline_id", "stage_index"], "value")
    return p.select("run_id", "pipeline_id", "stage_index", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "n")


@on("M", """SELECT run_id, pipeline_id, stage_index, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n, count(*) FILTER (value = 0) AS zero_count,
  round(100e0 * count(*) FILTER (value = 0) / count(*), 1) AS zero_pct FROM metrics GROUP BY 1, 2, 3""")  # fmt: skip
def A05_metric_aggregate(ev: Evidence) -> DataFrame:
    a = S.aggregate(ev("metrics"), ["run_id", "pipeline_id", "stage_index"])
    return a.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@on("M", "SELECT run_id, pipeline_id, CAST(ok % 3 AS BIGINT) AS segment, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM metrics GROUP BY 1, 2, 3")
def A13_segment_metrics(ev: Evidence) -> DataFrame:
    return ev("metrics").groupBy("run_id", "pipeline_id", (F.col("ok") % 3).alias("segment")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n"))


@on("M", """, deep AS (SELECT pipeline_id, query_id, arg_max(value, stage_index) AS value FROM metrics WHERE run_id = 'base' GROUP BY 1, 2)
SELECT query_id, pipeline_id AS winner, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY value DESC, pipeline_id) AS r FROM deep) WHERE r = 1""")  # fmt: skip
def A15_query_winners(ev: Evidence) -> DataFrame:
    deep = _runs(ev)[0].groupBy("pipeline_id", "query_id").agg(F.max_by("value", "stage_index").alias("value"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "pipeline_id"))
    return deep.withColumn("r", best).where("r = 1").select("query_id", F.col("pipeline_id").alias("winner"), F.round("value", 6).alias("value"))


_POINTS = """, pt AS (SELECT concat(pipeline_id, '-', stage_index) AS id, round(avg(value) FILTER (run_id = 'base'), 6) AS quality, round(avg(value) FILTER (run_id = 'cand'), 6) AS cost FROM metrics GROUP BY 1)"""


def _points(ev: Evidence) -> DataFrame:
    side = lambda r: F.round(F.avg(F.when(F.col("run_id") == r, F.col("value"))), 6)
    return ev("metrics").groupBy(F.concat_ws("-", "pipeline_id", "stage_index").alias("id")).agg(side("base").alias("quality"), side("cand").alias("cost"))


@on("M", f"{_POINTS} SELECT * FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt o WHERE o.quality >= p.quality AND o.cost <= p.cost AND (o.quality > p.quality OR o.cost < p.cost))")
def A35_pareto_frontier(ev: Evidence) -> DataFrame:
    return C.pareto(_points(ev), "quality", "cost")


@on("M", f"""{_TESTS}, s AS (SELECT CASE WHEN effect - 1.96 * se >= -0.02 THEN 0 WHEN effect + 1.96 * se < -0.02 THEN 2 ELSE 1 END AS sev FROM bh)
SELECT CASE max(sev) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'HOLD' ELSE 'PASS' END AS decision, count(*) AS checks FROM s""")  # fmt: skip
def G08_release_decision(ev: Evidence) -> DataFrame:
    from evalquarry.operators.release import decide

    return decide(P07_large_sample_guards(ev))


@on("M", """, a AS (SELECT DISTINCT query_id FROM metrics WHERE run_id = 'base' AND ok % 7 = 3), b AS (SELECT DISTINCT query_id FROM metrics WHERE run_id = 'cand' AND ok % 7 = 3)
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS members, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS disagreement""")  # fmt: skip
def J27_slice_membership(ev: Evidence) -> DataFrame:
    base, cand = (m.where("ok % 7 = 3").select("query_id").distinct() for m in _runs(ev))
    n = lambda d, c: d.agg(F.count("*").alias(c))
    return n(base.union(cand).distinct(), "members").join(n(base.exceptAll(cand).union(cand.exceptAll(base)), "disagreement"), F.lit(True))


@on("M", "SELECT pipeline_id, stage_index, query_id, value FROM metrics WHERE run_id = 'base' AND (pipeline_id, stage_index, query_id) > ('A', 3, '2') ORDER BY 1, 2, 3 LIMIT 26")
def W14_keyset_page(ev: Evidence) -> DataFrame:
    from evalquarry.sources.store import keyset_page

    return keyset_page(_runs(ev)[0].select("pipeline_id", "stage_index", "query_id", "value"), {"pipeline_id": "A", "stage_index": 3, "query_id": "2"}, 25)


@on("M", "SELECT run_id, pipeline_id, metric_name, count(*) AS n, round(sum(value), 6) AS total FROM metrics WHERE run_id = 'base' GROUP BY 1, 2, 3")
def S11_metric_sink(ev: Evidence) -> DataFrame:
    from evalquarry.sources.store import append_new

    base = _runs(ev)[0]
    stored = base.where("ok % 2 = 0")
    return append_new(stored, base.union(base), ["run_id", *KEY, "query_id"]).groupBy("run_id", "pipeline_id", "metric_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))

"""Queries of reports, lineage and comparison pages (bindings V, T, Q and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.catalog import codecs as K
from evalquarry.catalog import evidence as E
from evalquarry.catalog import retrieval as C
from evalquarry.catalog import runs as G
from evalquarry.operators import journeys as J
from evalquarry.operators import lineage as L
from evalquarry.operators import reporting as P
from evalquarry.operators import scoring as S
from evalquarry.plans import config as D
from evalquarry.plans import evaluate as V
from evalquarry.registry import on
from evalquarry.sources import store

_AGG = f"""{C._LONG}{G._DEPTH}, vals AS (SELECT l.run_id AS pipeline_id, stage AS stage_index, metric_name, k, nullif(branch, '') AS branch_id, value FROM long l JOIN lay ON lay.run_id = l.run_id AND lay.op_id = l.op_id
  UNION ALL SELECT run_id, -1, metric_name, k, NULL, value FROM long WHERE op_id = 'select'
  UNION ALL SELECT run_id, -1, 'latency_ms', 0, NULL, sum(latency_ms) FROM spans WHERE status = 'FIRED' GROUP BY run_id, query_id
  UNION ALL SELECT s.run_id, stage, 'latency_ms', 0, nullif(branch, ''), latency_ms FROM spans s JOIN lay ON lay.run_id = s.run_id AND lay.op_id = s.op_id WHERE status = 'FIRED'),
ag0 AS (SELECT pipeline_id, stage_index, metric_name, k, branch_id, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, count(*) AS n, round(100e0 * count(*) FILTER (value = 0) / count(*), 1) AS zero_pct FROM vals GROUP BY 1, 2, 3, 4, 5),
ag AS (SELECT *, mean - 1.96 * sd / sqrt(n) AS low, mean + 1.96 * sd / sqrt(n) AS high FROM ag0)"""


def aggregates(ev: Evidence) -> DataFrame:
    """One row per metric key: stages by the union layout, the final answer and its latency at -1."""
    lay = F.broadcast(G.layout(ev).withColumn("branch_id", F.nullif("branch", F.lit(""))))  # tens of operators
    long, fired = C.long(ev), ev("spans").where("status = 'FIRED'")
    names = ["pipeline_id", "stage_index", "metric_name", "k", "branch_id", "value"]
    at = lambda df: df.join(lay, ["run_id", "op_id"]).select(F.col("run_id").alias("pipeline_id"), F.col("stage").alias("stage_index"), "metric_name", "k", "branch_id", "value")
    end = lambda df: df.select(F.col("run_id").alias("pipeline_id"), F.lit(-1).alias("stage_index"), "metric_name", "k", F.lit(None).cast("string").alias("branch_id"), "value")
    ms = {"metric_name": F.lit("latency_ms"), "k": F.lit(0)}
    whole = fired.groupBy("run_id", "query_id").agg(F.sum("latency_ms").alias("value")).withColumns(ms)
    vals = at(long).unionByName(end(long.where("op_id = 'select'"))).unionByName(end(whole)).unionByName(at(fired.withColumn("value", F.col("latency_ms")).withColumns(ms)))
    a = S.aggregate(vals.select(*names), names[:-1])
    half = 1.96 * F.col("std") / F.sqrt("n")
    return a.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


@on("V", f"""{_AGG} SELECT pipeline_id, metric_name, k, round(mean, 6) AS mean, 'quality' AS kind FROM ag WHERE stage_index = -1 AND metric_name IN ('recall', 'ndcg', 'precision')
UNION ALL SELECT pipeline_id, metric_name, k, round(mean, 6), 'operational' FROM ag WHERE stage_index = -1 AND metric_name = 'latency_ms'""")
def A17_headline_metrics(ev: Evidence) -> DataFrame:
    return P.headline(aggregates(ev)).withColumn("mean", F.round("mean", 6))


@on("V", f"""{_AGG} SELECT a.pipeline_id, round(a.mean, 6) AS ndcg, round(b.mean, 6) AS recall FROM ag a JOIN ag b ON b.pipeline_id = a.pipeline_id AND b.stage_index = -1 AND b.metric_name = 'recall' AND b.k = 10
WHERE a.stage_index = -1 AND a.metric_name = 'ndcg' AND a.k = 10 ORDER BY a.mean DESC, b.mean DESC, a.pipeline_id LIMIT 1""")
def A16_headline_winner(ev: Evidence) -> DataFrame:
    w = P.winner(aggregates(ev))
    return w.select("pipeline_id", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"))


@on("V", f"""{_AGG}, q AS (SELECT * FROM ag WHERE metric_name <> 'latency_ms' AND branch_id IS NULL) SELECT pipeline_id, stage_index, metric_name, k, 'zeros' AS warning FROM q WHERE zero_pct > 20
UNION ALL SELECT pipeline_id, stage_index, metric_name, k, 'wide_interval' FROM q WHERE n >= 10 AND ((high - low) / greatest(abs(mean), 0.001) >= 0.35 OR (high - low >= 0.05 AND abs(mean) < 0.2))""")
def A18_overview_warnings(ev: Evidence) -> DataFrame:
    return P.warnings(aggregates(ev), least=10)


@on("V", f"""{_AGG}{K._COST}, cs AS (SELECT l.run_id, l.stage, sum(c.per_1k) AS per_1k FROM lay l JOIN sc c ON c.run_id = l.run_id AND c.op_id = l.op_id GROUP BY 1, 2)
SELECT ag.pipeline_id, ag.stage_index, coalesce(ag.branch_id, '') AS branch_id, ag.metric_name, ag.k, round(ag.mean, 6) AS mean, cs.per_1k FROM ag JOIN cs ON cs.run_id = ag.pipeline_id AND cs.stage = ag.stage_index WHERE stage_index >= 0""")
def A19_stage_matrix(ev: Evidence) -> DataFrame:
    lay = G.layout(ev)
    ops = ev("spans").select("run_id", "op_id", "op_type").distinct().join(lay, ["run_id", "op_id"])
    price = P.cost_per_1k(ops.select(F.concat_ws("|", "run_id", F.col("stage").cast("string")).alias("pipeline_id"), "op_id", "op_type"), K.costs(ev))
    a = aggregates(ev).where("stage_index >= 0").withColumn("at", F.concat_ws("|", "pipeline_id", F.col("stage_index").cast("string")))
    j = a.join(price.withColumnRenamed("pipeline_id", "at"), "at")
    return j.select("pipeline_id", "stage_index", F.coalesce("branch_id", F.lit("")).alias("branch_id"), "metric_name", "k", F.round("mean", 6).alias("mean"), "per_1k")


@on("V", f"""{_AGG}, t AS (SELECT *, CASE metric_name WHEN 'recall' THEN 1 WHEN 'ndcg' THEN 2 WHEN 'precision' THEN 3 WHEN 'mrr' THEN 4 WHEN 'map' THEN 5 ELSE 99 END AS q,
  CASE WHEN metric_name = 'ndcg' AND k = 10 AND stage_index = -1 THEN 0 WHEN metric_name <> 'latency_ms' AND branch_id IS NULL AND stage_index = -1 THEN 1 WHEN metric_name <> 'latency_ms' THEN 2 ELSE 3 END AS tier FROM ag)
SELECT pipeline_id, stage_index, metric_name, k, coalesce(branch_id, '') AS branch_id, tier, row_number() OVER (PARTITION BY pipeline_id ORDER BY tier, CASE WHEN tier = 2 THEN -stage_index ELSE 0 END, branch_id IS NOT NULL, q, k, metric_name, stage_index, coalesce(branch_id, '')) AS place FROM t""")
def W11_metric_key_ranking(ev: Evidence) -> DataFrame:
    r = P.ranked_keys(aggregates(ev), [("ndcg", 10)])
    return r.select("pipeline_id", "stage_index", "metric_name", "k", F.coalesce("branch_id", F.lit("")).alias("branch_id"), "tier", "place")


_KEYS = f"""{G._DEPTH}, ky AS (SELECT run_id || '|stage' || stage || '|latency_' || p || '@0' || CASE WHEN branch = '' THEN '' ELSE '|branch=' || branch END AS key, 10 * stage + i AS pos FROM lay, (VALUES ('p50', 1), ('p95', 2), ('p99', 3)) v(p, i)
  UNION ALL SELECT run_id || '|stage' || stage || '|recall@10', 10 * stage FROM lay WHERE branch = '')"""


@on("V", f"""{_KEYS} SELECT regexp_replace(key, '\\|latency_p[0-9]+@', '|latency_mean@') AS key, min(pos) AS pos FROM ky GROUP BY 1""")
def W12_latency_key_collapse(ev: Evidence) -> DataFrame:
    lay, head = G.layout(ev), F.concat(F.col("run_id"), F.lit("|stage"), F.col("stage").cast("string"))
    end = F.when(F.col("branch") == "", "").otherwise(F.concat(F.lit("|branch="), "branch"))
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(i).alias("i")) for p, i in (("p50", 1), ("p95", 2), ("p99", 3)))))
    lat = lay.withColumn("v", each).select(F.concat(head, F.lit("|latency_"), "v.p", F.lit("@0"), end).alias("key"), (10 * F.col("stage") + F.col("v.i")).alias("pos"))
    rec = lay.where("branch = ''").select(F.concat(head, F.lit("|recall@10")).alias("key"), (10 * F.col("stage")).alias("pos"))
    return P.one_latency(lat.unionByName(rec))


_SPINE = {"fuse": 0, "gate": 1, "expand": 2, "select": 3}


@on("V", f"""{C._WIDE}, v AS (SELECT run_id, op_id, query_id, ndcg_10 AS value, CASE op_id WHEN 'fuse' THEN 0 WHEN 'gate' THEN 1 WHEN 'expand' THEN 2 ELSE 3 END AS at FROM wide WHERE op_id IN ('fuse', 'gate', 'expand', 'select'))
SELECT b.run_id, a.op_id AS before_op, b.op_id AS after_op, count(*) AS n, round(avg(b.value - a.value), 6) AS delta, count(*) FILTER (b.value - a.value > 0) AS gained, count(*) FILTER (b.value - a.value < 0) AS lost
FROM v b JOIN v a ON a.run_id = b.run_id AND a.query_id = b.query_id AND a.at = b.at - 1 GROUP BY 1, 2, 3""")
def W19_stage_contributions(ev: Evidence) -> DataFrame:
    v = C.wide(ev, [5, 10]).select("run_id", "op_id", "query_id", F.round("ndcg_10", 12).alias("value"))
    return P.contributions(v, _SPINE).withColumn("delta", F.round("delta", 6))


@on("V", f"{_AGG}, p AS (SELECT stage_index || coalesce(branch_id, '') AS id, low, high FROM ag WHERE pipeline_id = 'A' AND metric_name = 'ndcg' AND k = 10) SELECT a.id AS a, b.id AS b, a.low <= b.high AND b.low <= a.high AS overlap FROM p a JOIN p b ON a.id < b.id")
def A36_interval_overlap(ev: Evidence) -> DataFrame:
    a = aggregates(ev).where("pipeline_id = 'A' and metric_name = 'ndcg' and k = 10")
    return P.overlaps(a.select(F.concat(F.col("stage_index").cast("string"), F.coalesce("branch_id", F.lit(""))).alias("id"), "low", "high"))


@on("V", f"""{C._WIDE}, m AS (SELECT run_id, op_id, avg(recall_10) AS r, avg(ndcg_10) AS n FROM wide GROUP BY 1, 2) SELECT a.run_id, a.op_id AS before_op, b.op_id AS after_op,
CASE WHEN b.r - a.r > 0.001 THEN 'recovery' WHEN b.n - a.n > 0.001 THEN 'reordering' ELSE 'no_gain' END AS mode FROM m a JOIN m b ON b.run_id = a.run_id AND a.op_id IN ('lexical', 'fuse') AND b.op_id IN ('rerank', 'select')""")
def A37_rerank_mode(ev: Evidence) -> DataFrame:
    m = C.wide(ev, [5, 10]).groupBy("run_id", "op_id").agg(F.avg("recall_10").alias("r"), F.avg("ndcg_10").alias("n"))
    a = m.where("op_id in ('lexical', 'fuse')").select("run_id", F.col("op_id").alias("before_op"), F.col("r").alias("r0"), F.col("n").alias("n0"))
    b = m.where("op_id in ('rerank', 'select')").select("run_id", F.col("op_id").alias("after_op"), "r", "n")
    return a.join(b, "run_id").select("run_id", "before_op", "after_op", P.rerank_mode(F.col("r") - F.col("r0"), F.col("n") - F.col("n0")).alias("mode"))


@on("V", f"""{C._WIDE}, m AS (SELECT run_id, op_id, round(avg(ndcg_10), 9) AS n FROM wide GROUP BY 1, 2), l AS (SELECT run_id, avg(v) AS ms FROM (SELECT run_id, query_id, sum(latency_ms) AS v FROM spans WHERE status = 'FIRED' GROUP BY 1, 2) GROUP BY 1)
SELECT f.run_id, round(f.n, 6) AS final_ndcg, round(l.ms, 6) AS mean_ms, round(1000 * f.n / l.ms, 6) AS quality_per_ms, (SELECT op_id FROM m WHERE m.run_id = f.run_id ORDER BY n DESC, op_id LIMIT 1) AS best_op, (SELECT op_id FROM m WHERE m.run_id = f.run_id ORDER BY n, op_id LIMIT 1) AS worst_op
FROM m f JOIN l USING (run_id) WHERE f.op_id = 'select'""")
def A38_run_analytics(ev: Evidence) -> DataFrame:
    m = C.wide(ev, [5, 10]).groupBy("run_id", "op_id").agg(F.round(F.avg("ndcg_10"), 9).alias("n"))
    ends = m.groupBy("run_id").agg(F.max(F.when(F.col("op_id") == "select", F.col("n"))).alias("final"), F.min(F.struct((-F.col("n")).alias("v"), "op_id")).alias("best"), F.min(F.struct(F.col("n").alias("v"), "op_id")).alias("worst"))
    ms = ev("spans").where("status = 'FIRED'").groupBy("run_id", "query_id").agg(F.sum("latency_ms").alias("v")).groupBy("run_id").agg(F.avg("v").alias("ms"))
    return ends.join(ms, "run_id").select("run_id", F.round("final", 6).alias("final_ndcg"), F.round("ms", 6).alias("mean_ms"), F.round(1000 * F.col("final") / F.col("ms"), 6).alias("quality_per_ms"), F.col("best.op_id").alias("best_op"), F.col("worst.op_id").alias("worst_op"))


@on("V", "SELECT count(DISTINCT query_id) * count(DISTINCT run_id) AS expected, count(DISTINCT trace_id) AS recorded FROM spans")
def A44_expected_traces(ev: Evidence) -> DataFrame:
    return ev("spans").agg((F.countDistinct("query_id") * F.countDistinct("run_id")).alias("expected"), F.countDistinct("trace_id").alias("recorded"))


@on("V", "SELECT run_id, string_agg(upper(left(op_id, 1)) || substr(op_id, 2), ' > ' ORDER BY span_idx) AS display, count(*) FILTER (op_type IN ('SOURCE', 'RERANK')) AS models FROM (SELECT DISTINCT run_id, span_idx, op_id, op_type FROM spans) GROUP BY 1")
def A45_pipeline_display(ev: Evidence) -> DataFrame:
    ops = ev("spans").select("run_id", "span_idx", "op_id", "op_type").distinct()
    names = F.transform(F.array_sort(F.collect_list(F.struct("span_idx", P.label(F.col("op_id")).alias("l")))), lambda x: x["l"])
    return ops.groupBy("run_id").agg(F.array_join(names, " > ").alias("display"), F.count_if(F.col("op_type").isin("SOURCE", "RERANK")).alias("models"))


@on("V", f"""{C._WIDE}, tr0 AS (SELECT q.query_id, q.doc_id, abs(CAST(substr(q.query_id, 2) AS BIGINT) - CAST(substr(q.doc_id, 2) AS BIGINT)) AS distance FROM qrels q WHERE grade > 0),
tr1 AS (SELECT c.op_id, r.query_id, sum(exp(-1e0 * r.distance / 100e0)) FILTER (c.rank <= 10) AS got FROM tr0 r JOIN cands c ON c.query_id = r.query_id AND c.doc_id = r.doc_id AND c.side = 'out' AND c.run_id = 'A' WHERE c.op_id IN ('lexical', 'filter', 'fuse') GROUP BY 1, 2),
tr2 AS (SELECT query_id, sum(exp(-1e0 * distance / 100e0)) AS want FROM tr0 GROUP BY 1), ops AS (SELECT * FROM (VALUES ('lexical'), ('filter'), ('fuse')) o(op_id))
SELECT op_id, query_id, 'recall' AS metric_name, round(recall_10, 6) AS value FROM wide WHERE run_id = 'A' AND op_id IN ('lexical', 'filter', 'fuse')
UNION ALL SELECT ops.op_id, tr2.query_id, 'temporal_recall', round(coalesce(tr1.got, 0) / tr2.want, 6) FROM ops CROSS JOIN tr2 LEFT JOIN tr1 ON tr1.op_id = ops.op_id AND tr1.query_id = tr2.query_id
UNION ALL SELECT op_id, query_id, 'profile_span', CAST(span_idx AS DOUBLE) FROM spans WHERE run_id = 'A' AND op_id IN ('lexical', 'filter', 'fuse')
UNION ALL SELECT op_id, query_id, 'profile_ms', latency_ms FROM spans WHERE run_id = 'A' AND op_id IN ('lexical', 'filter', 'fuse')""")
def A02_snapshot_fan_out(ev: Evidence) -> DataFrame:
    """Stages of a linear pipeline: quality, recall weighed by distance, and what was profiled."""
    ops, number = "run_id = 'A' and op_id in ('lexical', 'filter', 'fuse')", lambda c: F.substring(c, 2, 20).cast("long")
    recall = C.wide(ev, [5, 10]).where(ops).select("op_id", "query_id", F.lit("recall").alias("metric_name"), F.round("recall_10", 6).alias("value"))
    rel = ev("qrels").where("grade > 0").withColumn("distance", F.abs(number("query_id") - number("doc_id")))
    out = recall
    for op in ("lexical", "filter", "fuse"):
        t = S.temporal_recall(C._lists(ev, op), rel, 10, 100.0)
        out = out.unionByName(t.select(F.lit(op).alias("op_id"), "query_id", F.lit("temporal_recall").alias("metric_name"), F.round("temporal_recall", 6).alias("value")))
    profile = F.create_map(F.lit("profile_span"), F.col("span_idx").cast("double"), F.lit("profile_ms"), F.col("latency_ms"))
    return out.unionByName(ev("spans").where(ops).select("op_id", "query_id", F.explode(profile).alias("metric_name", "value")))


_TOPO = """, te AS (SELECT run_id, trace_id, op_id, concat_ws('|', op_id, op_type, array_to_string(list_sort(string_split(parents, ',')), ','), status) AS s FROM spans),
th AS (SELECT run_id, trace_id, sha256(string_agg(DISTINCT s, ';' ORDER BY s)) AS topology, string_agg(DISTINCT op_id, ',' ORDER BY op_id) AS ops FROM te GROUP BY 1, 2)"""


def _topologies(ev: Evidence) -> DataFrame:
    each = F.concat_ws("|", "op_id", "op_type", F.array_join(F.array_sort(F.split("parents", ",")), ","), "status")
    return ev("spans").groupBy("run_id", "trace_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(each)), ";"), 256).alias("topology"), F.array_join(F.array_sort(F.collect_set("op_id")), ",").alias("ops"))


@on("V", f"{_TOPO} SELECT topology, ops, count(DISTINCT trace_id) AS traces FROM th GROUP BY 1, 2")
def A10_topology_variants(ev: Evidence) -> DataFrame:
    return _topologies(ev).groupBy("topology", "ops").agg(F.countDistinct("trace_id").alias("traces"))


@on("V", f"{_TOPO} SELECT run_id, topology, min(trace_id) AS first_trace, min(ops) AS ops FROM th GROUP BY 1, 2")
def A29_topology_descriptors(ev: Evidence) -> DataFrame:
    return _topologies(ev).groupBy("run_id", "topology").agg(F.min("trace_id").alias("first_trace"), F.min("ops").alias("ops"))


_COUNTED = "count(*) AS pairs, count(*) FILTER (outcome = 'relevant_delivered') AS delivered, count(*) FILTER (membership = 'excluded') AS excluded"
_SUMMARIES = f"""{E._ROWS}, sm AS (SELECT run_id, 'run' AS kind, '' AS key, {_COUNTED} FROM jo GROUP BY 1 UNION ALL SELECT run_id, 'query', query_id, {_COUNTED} FROM jo GROUP BY 1, 3
  UNION ALL SELECT run_id, 'document', doc_id, {_COUNTED} FROM jo GROUP BY 1, 3 UNION ALL SELECT run_id, 'stage', coalesce(loss_boundary, ''), {_COUNTED} FROM jo GROUP BY 1, 3)"""


@on("V", f"{_SUMMARIES} SELECT * FROM sm")
def A27_summaries(ev: Evidence) -> DataFrame:
    return V.summaries(E._rows(ev))


@on("V", f"{_SUMMARIES} SELECT run_id, key, pairs FROM sm WHERE kind = 'document' AND starts_with(key, 'd1') AND key > 'd12' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY key) <= 21")
def W15_summary_page(ev: Evidence) -> DataFrame:
    s = V.summaries(E._rows(ev)).where((F.col("kind") == "document") & F.col("key").startswith("d1") & (F.col("key") > "d12"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("key"))
    return s.withColumn("place", place).where("place <= 21").select("run_id", "key", "pairs")


_KIND = f"""{E._ROWS}, oc AS (SELECT *, CASE WHEN membership = 'included' THEN CASE judgment WHEN 'relevant' THEN 'relevant_retained' WHEN 'nonrelevant' THEN 'irrelevant_retained' ELSE 'unknown_relevance' END WHEN NOT observed THEN 'relevant_lost_upstream'
  WHEN loss_boundary IS NULL OR loss_boundary = 'unknown' THEN 'lineage_incomplete' WHEN judgment = 'unknown' THEN 'unknown_relevance' WHEN judgment = 'relevant' THEN 'relevant_dropped_at_stage' ELSE 'irrelevant_removed' END AS kind,
  CASE WHEN NOT observed THEN 'retrieval_entry' ELSE coalesce(loss_boundary, 'final') END AS operator FROM jo)"""


@on("V", f"{_KIND} SELECT trace_id, doc_id, kind FROM oc")
def W09_outcome_classification(ev: Evidence) -> DataFrame:
    return L.outcomes(E._rows(ev)).select("trace_id", "doc_id", "kind")


@on("V", f"{_KIND} SELECT trace_id, kind, operator, count(*) AS n FROM oc GROUP BY GROUPING SETS ((trace_id, kind), (trace_id, kind, operator))")
def A30_stage_loss_accounting(ev: Evidence) -> DataFrame:
    return L.losses(E._rows(ev), "trace_id")


@on("V", f"{_KIND} SELECT left(trace_id, 1) AS run_id, kind, count(*) AS n FROM oc GROUP BY 1, 2")
def A31_lineage_merge(ev: Evidence) -> DataFrame:
    per = L.losses(E._rows(ev), "trace_id").where("operator is null")
    return per.groupBy(F.left("trace_id", F.lit(1)).alias("run_id"), "kind").agg(F.sum("n").alias("n"))


@on("V", f"{_AGG}, k AS (SELECT DISTINCT metric_name, k, metric_name || '@' || k AS key FROM ag) SELECT metric_name, k, key FROM k WHERE metric_name = 'ndcg' ORDER BY k DESC LIMIT 1")
def J07_primary_metric(ev: Evidence) -> DataFrame:
    long = C.long(ev).where("op_id = 'select'").select("run_id", "query_id", "metric_name", "k").distinct()
    both = long.groupBy("metric_name", "k", "query_id").agg(F.countDistinct("run_id").alias("runs")).groupBy("metric_name", "k").agg(F.count_if(F.col("runs") == 2).alias("paired"))
    return P.primary(both.withColumn("key", F.concat("metric_name", F.lit("@"), F.col("k").cast("string")))).select("metric_name", "k", "key")


@on("V", "SELECT query_id, doc_id, grade FROM qrels")
def J15_qrels_conversion(ev: Evidence) -> DataFrame:
    """Long to nested by query and back."""
    nested = ev("qrels").groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "grade"))).alias("judged"))
    return nested.select("query_id", F.explode("judged").alias("doc_id", "grade"))


@on("Q", "SELECT c.conv_id, c.turn, l.quality, d.lang FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id JOIN documents d ON d.doc_id = c.conv_id")
def J16_query_lineage(ev: Evidence) -> DataFrame:
    """A test query with its scenario, if it has one, and the run that used it."""
    c = ev("conversations").select("conv_id", "turn")
    scenario = ev("labels").select(F.col("doc_id").alias("conv_id"), "quality")
    return c.join(scenario, "conv_id", "left").join(ev("documents").select(F.col("doc_id").alias("conv_id"), "lang"), "conv_id")


@on("T", """, q AS (SELECT DISTINCT service_id, op_id FROM t_spans WHERE latency_ms > 60), t AS (SELECT event_id, ts, op_id, [op_id, status] AS labels, CASE WHEN latency_ms > 60 THEN 'hard' ELSE 'easy' END AS difficulty FROM t_spans)
SELECT q.service_id, q.op_id, t.event_id FROM q JOIN t ON t.difficulty = 'hard' AND list_contains(t.labels, q.op_id) QUALIFY row_number() OVER (PARTITION BY q.service_id, q.op_id ORDER BY t.event_id DESC) <= 3""")
def J17_categorical_matches(ev: Evidence) -> DataFrame:
    """Recorded traces of the same difficulty that share a label with a test query, the newest of each.
    They meet by label, each label's newest alone, so frequent labels don't pair all with all."""
    hard = F.col("latency_ms") > 60
    q = ev("t_spans").where(hard).select("service_id", "op_id").distinct()
    t = ev("t_spans").where(hard).select("event_id", F.explode(F.array("op_id", "status")).alias("label"))
    newest = t.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("event_id")))).where("n <= 3")
    return q.join(newest, F.col("op_id") == F.col("label")).select("service_id", "op_id", "event_id")


_STAGES = """, p AS (SELECT DISTINCT op_id, parents FROM spans WHERE run_id = 'A' AND parents <> ''), st AS (SELECT op_id, unnest(string_split(parents, ',')) AS s, generate_subscripts(string_split(parents, ','), 1) - 1 AS i FROM p)"""


@on("V", f"""{_STAGES} SELECT op_id AS pipeline, -1 AS stage, CASE op_id WHEN 'filter' THEN 'removed' WHEN 'fuse' THEN 'changed' ELSE 'unchanged' END AS change FROM p
UNION ALL SELECT 'cache', -1, 'added' UNION ALL SELECT op_id, i, CASE WHEN s = 'filter' THEN 'changed' ELSE 'unchanged' END FROM st WHERE op_id <> 'filter'""")
def J26_config_diff(ev: Evidence) -> DataFrame:
    before = {n.id: [{"reads": p} for p in n.inputs] for n in G._nodes(ev)["A"] if n.inputs}
    after = {k: [{"reads": "lexical" if s["reads"] == "filter" else s["reads"]} for s in v] for k, v in before.items() if k != "filter"} | {"cache": [{"reads": "select"}]}
    return ev.spark.createDataFrame(D.config_diff(before, after), "pipeline string, stage bigint, change string")


@on("V", """, n AS (SELECT run_id, count(DISTINCT query_id) AS q, count(*) FILTER (status = 'FIRED') AS f FROM spans GROUP BY 1), d AS (SELECT count(DISTINCT q) > 1 AS dq, count(DISTINCT f) > 1 AS df FROM n)
SELECT 'dataset.corpus_hash' AS axis, 'high' AS severity, 'unknown' AS status UNION ALL SELECT 'dataset.query_hash', 'high', 'invalid' FROM d WHERE dq UNION ALL SELECT 'execution.seed', 'low', 'warning' FROM d WHERE df
UNION ALL SELECT 'models', 'medium', 'warning' UNION ALL SELECT a, 'low', 'unknown' FROM (VALUES ('execution.cache'), ('execution.timeout_ms'), ('git_commit'), ('packages')) v(a)""")
def J29_comparison_validity(ev: Evidence) -> DataFrame:
    n = ev("spans").groupBy("run_id").agg(F.countDistinct("query_id").alias("q"), F.count_if(F.col("status") == "FIRED").alias("f")).orderBy("run_id").collect()  # a row a run
    manifests = [{"dataset": {"query_hash": r["q"], "qrel_hash": "x"} | ({"corpus_hash": "c"} if r["run_id"] == "A" else {}), "labeling": {"method": "gold"}, "execution": {"seed": r["f"]}, "models": [r["run_id"]]} for r in n]
    return ev.spark.createDataFrame(D.validity(manifests), "axis string, severity string, status string")


_REV = """, rv AS (SELECT run_id, doc_id, CAST(substr(doc_id, 2) AS BIGINT) % 3 + CASE WHEN run_id = 'B' AND CAST(substr(doc_id, 2) AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS revision FROM cands WHERE op_id = 'dense' AND side = 'out')"""


def _revisions(ev: Evidence) -> DataFrame:
    n = F.substring("doc_id", 2, 20).cast("long")
    return ev("cands").where("op_id = 'dense' and side = 'out'").select("run_id", "trace_id", F.col("doc_id").alias("chunk"), (n % 3 + F.when((F.col("run_id") == "B") & (n % 5 == 0), 1).otherwise(0)).alias("revision"))


@on("V", f"{_REV} SELECT DISTINCT a.doc_id AS chunk FROM rv a JOIN rv b ON a.run_id = 'A' AND b.run_id = 'B' AND a.doc_id = b.doc_id WHERE a.revision <> b.revision")
def J30_revision_mismatches(ev: Evidence) -> DataFrame:
    r = _revisions(ev)
    return L.revision_mismatches(r.where("run_id = 'A'"), r.where("run_id = 'B'"))


@on("V", """, i AS (SELECT trace_id, doc_id, CASE WHEN CAST(substr(doc_id, 2) AS BIGINT) % 13 <> 0 THEN 1 END AS revision FROM cands WHERE op_id = 'fuse' AND side = 'in'),
t AS (SELECT trace_id, doc_id FROM i WHERE revision IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)
SELECT trace_id, coalesce(m, 0) AS missing, coalesce(r, 0) AS repeated FROM (SELECT trace_id, count(*) AS m FROM i WHERE revision IS NULL GROUP BY 1) FULL JOIN (SELECT trace_id, count(*) AS r FROM t GROUP BY 1) USING (trace_id)""")
def J31_identity_index(ev: Evidence) -> DataFrame:
    n = F.substring("doc_id", 2, 20).cast("long")
    rows = ev("cands").where("op_id = 'fuse' and side = 'in'").select("trace_id", F.col("doc_id").alias("chunk"), F.when(n % 13 != 0, 1).alias("revision"))
    return L.identity_problems(rows, "trace_id")


@on("V", """SELECT 'mapped' AS mapping, count(*) FILTER (op_id = 'nothing') AS differences FROM spans UNION ALL SELECT 'plain', 2 + 2 * count(DISTINCT op_id) FILTER (parents LIKE '%fast%') FROM spans WHERE run_id = 'A'""")
def J32_topology_alignment(ev: Evidence) -> DataFrame:
    """Run B with an operator renamed, with and without the mapping of stages."""
    s = ev("spans")
    b = s.where("run_id = 'B'").withColumn("op_id", F.when(F.col("op_id") == "fast", "quick").otherwise(F.col("op_id"))).withColumn("parents", F.replace("parents", F.lit("fast"), F.lit("quick")))
    one = lambda name, m: L.misaligned(L.signatures(s.where("run_id = 'A'")), L.signatures(b, m)).agg(F.lit(name).alias("mapping"), F.count("*").alias("differences"))
    return one("mapped", {"quick": "fast"}).unionByName(one("plain", None))


@on("V", "SELECT query_id, 'default:' || doc_id AS entity, grade FROM qrels WHERE grade > 0")
def J33_document_qrels(ev: Evidence) -> DataFrame:
    return ev("qrels").where("grade > 0").select("query_id", F.concat_ws(":", F.lit("default"), "doc_id").alias("entity"), "grade")


@on("V", f"""{E._ROWS} SELECT trace_id, doc_id, CASE outcome WHEN 'relevant_delivered' THEN 'survived' WHEN 'not_observed' THEN 'never_retrieved' WHEN 'insufficient_evidence' THEN 'unknown' ELSE 'dropped' END AS state,
  CASE WHEN outcome IN ('relevant_excluded', 'retained_below_cutoff') THEN loss_boundary END AS dropped_at, CASE WHEN length('text of ' || repeat(doc_id || ' ', 40)) > 160 THEN left('text of ' || repeat(doc_id || ' ', 40), 157) || '...' ELSE 'text of ' || repeat(doc_id || ' ', 40) END AS preview
FROM jo WHERE judgment = 'relevant'""")
def W07_miss_table(ev: Evidence) -> DataFrame:
    text = F.concat(F.lit("text of "), F.repeat(F.concat("doc_id", F.lit(" ")), F.lit(40)))
    return J.miss_table(E._rows(ev).where("judgment = 'relevant'").withColumn("text", text)).select("trace_id", "doc_id", "state", "dropped_at", "preview")


@on("V", f"{E._ROWS} SELECT trace_id, doc_id, outcome, n_events FROM jo")
def W16_pair_facts(ev: Evidence) -> DataFrame:
    return E._rows(ev).select("trace_id", "doc_id", "outcome", "n_events")


@on("V", f"{G._DEPTH}, f1 AS (SELECT run_id, parent AS arm, op_id AS fuse_op, 1 AS steps FROM e WHERE op_id = 'fuse'), f2 AS (SELECT e.run_id, e.parent AS arm, f1.fuse_op, 2 AS steps FROM e JOIN f1 ON f1.run_id = e.run_id AND f1.arm = e.op_id WHERE e.parent <> '') SELECT * FROM f1 UNION ALL SELECT * FROM f2")
def W18_fuse_stage_pairing(ev: Evidence) -> DataFrame:
    """For every operator before a fusion, the nearest fusion after it and how far it is."""
    rows = []
    for run, nodes in G._nodes(ev).items():
        readers = {n.id: [m.id for m in nodes if n.id in m.inputs] for n in nodes}
        kinds = {n.id: n.type for n in nodes}
        for n in nodes:
            front, steps = readers[n.id], 1
            while front and not any(kinds[x] == "FUSE" for x in front):
                front, steps = sorted({y for x in front for y in readers[x]}), steps + 1
            if front:
                rows.append((run, n.id, min(x for x in front if kinds[x] == "FUSE"), steps))
    return ev.spark.createDataFrame(rows, "run_id string, arm string, fuse_op string, steps int")


@on("V", "SELECT trace_id, (SELECT count(DISTINCT trace_id) FROM spans) > 13 AS has_more FROM (SELECT DISTINCT trace_id FROM spans ORDER BY trace_id LIMIT 10 OFFSET 3)")
def W21_trace_pagination(ev: Evidence) -> DataFrame:
    probe = ev("spans").select("trace_id").distinct().orderBy("trace_id").offset(3).limit(11).collect()  # a page and one more
    return ev.spark.createDataFrame([(r[0], len(probe) > 10) for r in probe[:10]], "trace_id string, has_more boolean")


@on("V", f"{E._DIFF} SELECT query_id, doc_id, change FROM df ORDER BY change, query_id, doc_id LIMIT 25 OFFSET 25")
def W22_comparison_page(ev: Evidence) -> DataFrame:
    return E._diff(ev).orderBy("change", "query_id", "doc_id").offset(25).limit(25).select("query_id", "doc_id", "change")


@on("V", f"{E._DIFF} SELECT query_id, doc_id, change, coalesce(before_rank, 0) AS before_rank, coalesce(after_rank, 0) AS after_rank FROM df WHERE alignment = 'aligned'")
def W23_membership_change(ev: Evidence) -> DataFrame:
    return E._diff(ev).where("alignment = 'aligned'").select("query_id", "doc_id", "change", F.coalesce("before_rank", F.lit(0)).alias("before_rank"), F.coalesce("after_rank", F.lit(0)).alias("after_rank"))


@on("V", f"{G._DEPTH} SELECT DISTINCT run_id, op_id FROM spans WHERE op_id <> 'select' OR is_final")
def W25_final_path(ev: Evidence) -> DataFrame:
    return J.ancestors(ev("spans"))


@on("V", f"""{E._RULES} SELECT trace_id, 'expand_loss' AS label, CASE WHEN n > 0 THEN 'supported' ELSE 'not_observed' END AS availability, n AS n_documents FROM (SELECT tr.trace_id, count(DISTINCT z.doc_id) AS n FROM tr LEFT JOIN (SELECT g.trace_id, g.doc_id FROM
  (SELECT trace_id, op_id, doc_id FROM sp WHERE op_type = 'EXPAND' GROUP BY ALL HAVING count(*) FILTER (side = 'out') = 0) g JOIN rl USING (trace_id, doc_id)) z USING (trace_id) GROUP BY 1)""")
def D05_transition_loss(ev: Evidence) -> DataFrame:
    """The base of the loss rules, on an operator type that has no rule of its own."""
    from evalquarry.operators import diagnostics as R

    return R.transition_loss("expand_loss", "op_type = 'EXPAND' and status = 'FIRED'")(E._context(ev))


@on("V", "SELECT run_id, op_id, CASE WHEN count(*) FILTER (status = 'FIRED') = 0 THEN 'unavailable' WHEN count(*) FILTER (status = 'FIRED') < count(*) THEN 'partial' ELSE 'ready' END AS state, round(count(*) FILTER (status = 'FIRED') * 1e0 / count(*), 6) AS coverage FROM spans GROUP BY 1, 2")
def N08_result_contract(ev: Evidence) -> DataFrame:
    from evalquarry.operators.analysis import contract

    s = ev("spans").groupBy("run_id", "op_id").agg(F.count_if(F.col("status") == "FIRED").alias("have"), F.count("*").alias("want"))
    return s.select("run_id", "op_id", contract(F.col("have"), F.col("want")).alias("c")).select("run_id", "op_id", "c.state", F.round("c.coverage", 6).alias("coverage"))


@on("T", "SELECT service_id, op_id, event_id FROM t_spans WHERE op_id = 'click' AND status = 'OK' QUALIFY row_number() OVER (PARTITION BY service_id ORDER BY event_id) <= 2")
def I10_equality_filters(ev: Evidence) -> DataFrame:
    t = store.where_equal(ev("t_spans"), op_id="click", status="OK", service_id=None, event_id=None)
    return t.withColumn("n", F.row_number().over(Window.partitionBy("service_id").orderBy("event_id"))).where("n <= 2").select("service_id", "op_id", "event_id")

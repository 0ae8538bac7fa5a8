"""Queries of release audits and of the investigation service (bindings M, T and V)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.catalog import comparing as M
from evalquarry.catalog import evidence as E
from evalquarry.catalog import reports as R
from evalquarry.operators import audit as A
from evalquarry.operators import comparison as C
from evalquarry.operators import journeys as J
from evalquarry.operators import judgments as G
from evalquarry.operators import release
from evalquarry.plans import config as P
from evalquarry.plans import evaluate as V
from evalquarry.plans.observe import Recorder, no_regression
from evalquarry.plans.storage import shared_folder
from evalquarry.registry import on
from evalquarry.sources import external
from evalquarry.sources.runstore import RunStore

AT = ["pipeline_id", "stage_index"]


@on("M", "SELECT run_id, pipeline_id, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.9), 6) AS q90 FROM metrics GROUP BY 1, 2")
def P05_quantile(ev: Evidence) -> DataFrame:
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return ev("metrics").groupBy("run_id", "pipeline_id").agg(q(0.25).alias("q25"), q(0.9).alias("q90"))


@on("M")
def P04_paired_effect_ci(ev: Evidence) -> DataFrame:
    return C.effects(C.paired(*M._runs(ev)), C.KEY).select("pipeline_id", "stage_index", "estimator", "effect", "low", "high")


@on("M")
def P13_analytics_bootstrap(ev: Evidence) -> DataFrame:
    return C.poisson_bootstrap(ev("metrics"), ["run_id", "pipeline_id", "stage_index"])


_NORMAL = f"""{M._PAIRS}, ni AS (SELECT pipeline_id, stage_index, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) AS low, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) AS high FROM pr GROUP BY 1, 2),
cv AS (SELECT pipeline_id, stage_index, count(DISTINCT query_id) AS attempted, count(DISTINCT query_id) FILTER (run_id = 'cand') AS paired FROM metrics GROUP BY 1, 2),
ck AS (SELECT cv.*, low, high, CASE WHEN paired = 0 THEN 'unavailable' WHEN paired < 60 THEN 'too_few_pairs' WHEN paired * 1e0 / attempted < 0.9 THEN 'pair_coverage' ELSE 'interval' END AS reason FROM cv LEFT JOIN ni USING (pipeline_id, stage_index)),
cs AS (SELECT pipeline_id, stage_index, attempted, paired, reason, CASE reason WHEN 'unavailable' THEN 'BLOCK' WHEN 'interval' THEN CASE WHEN low IS NULL THEN 'BLOCK' WHEN low >= -0.0105 THEN 'PASS' WHEN high < -0.0105 THEN 'FAIL' ELSE 'HOLD' END ELSE 'HOLD' END AS status FROM ck)"""


def _checks(ev: Evidence) -> DataFrame:
    base, cand = M._runs(ev)
    return A.checked(base, cand, AT, 0.0105, A.normal_intervals(C.paired(base, cand), AT).drop("effect"), least=60, min_coverage=0.9)


@on("M", f"{_NORMAL} SELECT * FROM cs")
def P08_resolved_checks(ev: Evidence) -> DataFrame:
    return _checks(ev).select(*AT, "attempted", "paired", "reason", "status")


@on("M", f"{_NORMAL} SELECT pipeline_id, stage_index, CASE WHEN low >= -0.0105 THEN 'PASS' WHEN high < -0.0105 THEN 'FAIL' ELSE 'HOLD' END AS higher, CASE WHEN high <= 0.0105 THEN 'PASS' WHEN low > 0.0105 THEN 'FAIL' ELSE 'HOLD' END AS lower FROM ni")
def P09_interval_status(ev: Evidence) -> DataFrame:
    i = A.normal_intervals(C.paired(*M._runs(ev)), AT)
    one = lambda lower: C.interval_status(F.col("low"), F.col("high"), F.lit(0.0105), F.lit(lower))
    return i.select(*AT, one(False).alias("higher"), one(True).alias("lower"))


_FAMILY = """, fm AS (SELECT pipeline_id, count(DISTINCT stage_index) AS family FROM metrics GROUP BY 1)"""


def _family(ev: Evidence) -> DataFrame:
    return ev("metrics").groupBy("pipeline_id").agg(F.countDistinct("stage_index").alias("family"))


@on("M", f"{_FAMILY} SELECT pipeline_id, family, round(greatest(0.95, 1 - 0.05 / family), 9) AS confidence FROM fm")
def P10_adjusted_confidence(ev: Evidence) -> DataFrame:
    return _family(ev).select("pipeline_id", "family", F.round(A.confidence(F.col("family")), 9).alias("confidence"))


@on("M", f"{_FAMILY} SELECT pipeline_id, CAST(ceil(40 / (1 - greatest(0.95, 1 - 0.05 / family)) - 1e-9) AS BIGINT) AS resamples, 1000 * (1 - greatest(0.95, 1 - 0.05 / family)) / 2 >= 20 AS enough FROM fm")
def P11_resample_floor(ev: Evidence) -> DataFrame:
    level = A.confidence(F.col("family"))
    return _family(ev).select("pipeline_id", A.resamples_needed(level).alias("resamples"), (1000 * (1 - level) / 2 >= 20).alias("enough"))


_EXEC = """, ex AS (SELECT pipeline_id, count(DISTINCT query_id) AS attempted, count(DISTINCT query_id) - count(DISTINCT query_id) FILTER (run_id = 'cand') AS failed FROM metrics GROUP BY 1)"""


@on("M", f"{_EXEC} SELECT pipeline_id, attempted, failed, round(failed * 1e0 / attempted, 6) AS failure_rate, CASE WHEN failed * 1e0 / attempted > 0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM ex")
def P12_execution_accounting(ev: Evidence) -> DataFrame:
    return A.execution(*M._runs(ev), ["pipeline_id"], 0.05).withColumn("failure_rate", F.round("failure_rate", 6))


def _keys(ev: Evidence) -> dict[str, set]:
    """The metric keys of each run, tens of them."""
    out: dict[str, set] = {}
    for r in ev("metrics").select("run_id", "pipeline_id", "stage_index", "metric_name", "k").distinct().collect():
        out.setdefault(r["run_id"], set()).add((r["pipeline_id"], r["stage_index"], r["metric_name"], r["k"], None))
    return out


def _policy(ev: Evidence) -> P.Policy:
    names = sorted({k[0] for keys in _keys(ev).values() for k in keys})
    return P.policy(json.dumps({"schema_version": 3, "id": "m", "metrics": [{"id": f"recall-{p.lower()}", "metric": "recall", "pipeline": p, "max_regression": 0.0105} for p in names], "statistics": {"resamples": 4000}}))


@on("M", "SELECT 'recall-' || lower(pipeline_id) AS id, run_id, pipeline_id || '|stage' || max(stage_index) || '|recall@10' AS key, 'resolved' AS status FROM metrics GROUP BY pipeline_id, run_id")
def G01_policy_resolution(ev: Evidence) -> DataFrame:
    rows = [(r.check.id, run, key, r.status) for r in P.resolve(_policy(ev), _keys(ev)) for run, key in r.keys.items()]
    return ev.spark.createDataFrame(rows, "id string, run_id string, key string, status string")


@on("M", """, p AS (SELECT count(DISTINCT pipeline_id) AS n, min(pipeline_id) AS first, max(stage_index) AS deep FROM metrics WHERE run_id = 'base')
SELECT 'any pipeline' AS variant, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, '' AS key FROM p UNION ALL SELECT 'unknown pipeline', 'absent', '' UNION ALL SELECT 'query', 'absent', '' UNION ALL SELECT 'operator', 'unsupported', ''
UNION ALL SELECT 'operator in layout', 'resolved', first || '|stage1|recall@10' FROM p UNION ALL SELECT 'two invocations', 'ambiguous', ''""")
def G02_key_resolution(ev: Evidence) -> DataFrame:
    keys = _keys(ev)["base"]
    first = min(k[0] for k in keys)
    layout = {"rank": (1, None), "fuse": (2, None), "fuse#2": (3, None)}
    tries = {
        "any pipeline": (P.Check("c", "recall"), None), "unknown pipeline": (P.Check("c", "recall", pipeline="none"), None), "query": (P.Check("c", "latency_ms", "query", pipeline=first), None),
        "operator": (P.Check("c", "recall", "operator:rank", pipeline=first), None), "operator in layout": (P.Check("c", "recall", "operator:rank", pipeline=first), layout), "two invocations": (P.Check("c", "recall", "operator:fuse", pipeline=first), layout),
    }
    got = {name: P.resolve_in_run(check, keys, lay) for name, (check, lay) in tries.items()}
    return ev.spark.createDataFrame([(name, status, key or "") for name, (key, status, _) in got.items()], "variant string, status string, key string")


@on("M", "SELECT DISTINCT lower(pipeline_id) || '-recall-10-final_retrieval' AS id, 'final_retrieval' AS target, 'recall' AS metric, 10 AS k FROM metrics UNION ALL SELECT DISTINCT lower(pipeline_id) || '-latency_ms-0-query', 'query', 'latency_ms', 0 FROM metrics")
def G03_policy_conversion(ev: Evidence) -> DataFrame:
    names = sorted({k[0] for keys in _keys(ev).values() for k in keys})
    guards = [{"metric": f"{p}|stage-1|recall@10", "max_regression": 0.01} for p in names] + [{"metric": f"{p}|stage-1|latency_ms@0", "direction": "lower_is_better", "max_regression": 5.0} for p in names]
    loaded = P.policy(json.dumps({"schema_version": 2, "id": "old", "metrics": guards, "statistics": {"resamples": 9000}}))
    return ev.spark.createDataFrame([(c.id, c.target, c.metric, c.k) for c in loaded.checks], "id string, target string, metric string, k int")


_SLICE = """, sg AS (SELECT b.ok % 3 AS segment, a.value - b.value AS delta FROM metrics b JOIN metrics a ON a.run_id = 'cand' AND b.run_id = 'base' AND a.pipeline_id = b.pipeline_id AND a.stage_index = b.stage_index AND a.query_id = b.query_id),
si AS (SELECT segment, count(*) AS n, avg(delta) - 1.96 * stddev_samp(delta) / sqrt(count(*)) AS low, avg(delta) + 1.96 * stddev_samp(delta) / sqrt(count(*)) AS high FROM sg GROUP BY 1)"""


@on("M", f"{_SLICE} SELECT w.segment, coalesce(n, 0) AS paired, CASE WHEN n IS NULL THEN 'BLOCK' WHEN low >= -0.0102 THEN 'PASS' WHEN high < -0.0102 THEN 'FAIL' ELSE 'HOLD' END AS status FROM (VALUES (0), (1), (2), (3)) w(segment) LEFT JOIN si ON si.segment = w.segment")
def G05_declared_slices(ev: Evidence) -> DataFrame:
    """Guards within declared values of a query's metadata; a value that no row has blocks."""
    base, cand = M._runs(ev)
    pairs = C.paired(base, cand).join(base.select(*C.KEY, "query_id", (F.col("ok") % 3).alias("segment")), [*C.KEY, "query_id"])
    got = A.normal_intervals(pairs, ["segment"]).join(pairs.groupBy("segment").agg(F.count("*").alias("n")), "segment")
    wanted = ev.spark.createDataFrame([(i,) for i in range(4)], "segment bigint")
    status = F.when(F.col("n").isNull(), "BLOCK").otherwise(C.interval_status(F.col("low"), F.col("high"), F.lit(0.0102), F.lit(False)))
    return wanted.join(got, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("paired"), status.alias("status"))


@on("M", """, sb AS (SELECT DISTINCT query_id, ok % 3 AS s FROM metrics WHERE run_id = 'base'), sc AS (SELECT DISTINCT query_id, CASE WHEN ok % 10 = 0 THEN (ok + 1) % 3 ELSE ok % 3 END AS s FROM metrics WHERE run_id = 'cand'),
u AS (SELECT query_id, s FROM sb UNION SELECT query_id, s FROM sc), d AS (SELECT sb.query_id FROM sb JOIN sc USING (query_id) WHERE sb.s <> sc.s)
SELECT u.s AS segment, count(DISTINCT u.query_id) AS members, count(d.query_id) AS disagreement FROM u LEFT JOIN d ON d.query_id = u.query_id GROUP BY 1""")
def G06_resolved_slices(ev: Evidence) -> DataFrame:
    base, cand = M._runs(ev)
    return A.membership(base.select("query_id", (F.col("ok") % 3).alias("segment")), cand.select("query_id", F.when(F.col("ok") % 10 == 0, (F.col("ok") + 1) % 3).otherwise(F.col("ok") % 3).alias("segment")))


@on("M", f"""{_NORMAL}, ex AS (SELECT DISTINCT pipeline_id, stage_index FROM metrics UNION ALL SELECT DISTINCT pipeline_id, 99 FROM metrics WHERE pipeline_id = 'A'), j AS (SELECT ex.pipeline_id, cs.status FROM ex LEFT JOIN cs USING (pipeline_id, stage_index))
SELECT pipeline_id, CASE max(CASE coalesce(status, 'BLOCK') WHEN 'PASS' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'FAIL' ELSE 'BLOCK' END AS decision, count(*) FILTER (status IS NULL) AS missing FROM j GROUP BY 1""")
def G07_release_decisions(ev: Evidence) -> DataFrame:
    """One decision per pipeline; one of them expects a check that has no result."""
    got = _checks(ev).select("pipeline_id", F.col("stage_index").cast("string").alias("check"), "status")
    wanted = ev("metrics").select("pipeline_id", F.col("stage_index").cast("string").alias("check")).distinct()
    wanted = wanted.unionByName(wanted.where("pipeline_id = 'A'").select("pipeline_id", F.lit("99").alias("check")).distinct())
    return A.decided(got, wanted, "pipeline_id")


def _manifests(ev: Evidence) -> dict[str, dict]:
    out = {}
    for r in ev("spans").groupBy("run_id").agg(F.countDistinct("query_id").alias("q"), F.countDistinct("op_id").alias("o")).collect():  # a row a run
        new = r["run_id"] == "B"
        out[r["run_id"]] = {
            "dataset": {"query_hash": r["q"], "qrel_hash": "j", "corpus_hash": "c2" if new else "c1"}, "labeling": {"method": "gold"}, "metric_versions": {"ndcg": 1}, "code_revision": f"{r['run_id']}1", "config_digest": f"o{r['o']}",
            "prompt_revision": None if new else "p", "index_encoder": {"index_revision": "e1", "query_revision": "e2" if new else "e1"},
        }
    return out


@on("V", """SELECT * FROM (VALUES ('dataset.query_hash', 'invariant', ''), ('dataset.qrel_hash', 'invariant', ''), ('dataset.corpus_hash', 'evidence_invalid', 'corpus_mismatch'), ('labeling.method', 'invariant', ''), ('metric_versions', 'invariant', ''), ('evaluation', 'unknown', 'required_manifest_field_missing')) v(field, class, finding)""")
def G13_invariant_comparison(ev: Evidence) -> DataFrame:
    m = _manifests(ev)
    return ev.spark.createDataFrame(P.invariants(m["A"], m["B"]), "field string, class string, finding string")


@on("V", "SELECT * FROM (VALUES ('code_revision', 'expected'), ('config_digest', 'invariant'), ('prompt_revision', 'unknown')) v(field, class)")
def G14_intervention_comparison(ev: Evidence) -> DataFrame:
    m = {r: {k: v for k, v in d.items() if k in P.PROVENANCE} for r, d in _manifests(ev).items()}
    return ev.spark.createDataFrame(list(release.interventions(m["A"], m["B"], {"code_revision"}).items()), "field string, class string")


@on("V", "SELECT * FROM (VALUES ('A', false, 'PASS', ''), ('B', false, 'HOLD', 'index_encoder_unverified'), ('A', true, 'PASS', ''), ('B', true, 'BLOCK', 'index_encoder_compatibility_required')) v(run_id, required, status, finding)")
def G15_encoder_consistency(ev: Evidence) -> DataFrame:
    rows = [(run, need, *P.encoder_consistency(m, need)) for run, m in _manifests(ev).items() for need in (False, True)]
    return ev.spark.createDataFrame(rows, "run_id string, required boolean, status string, finding string")


@on("V", "SELECT * FROM (VALUES ('invariants', 'BLOCK'), ('interventions', 'HOLD'), ('consistency', 'HOLD'), ('release', 'BLOCK')) v(scope, status)")
def G09_evidence_assessment(ev: Evidence) -> DataFrame:
    """Readiness of each scope of evidence, and of the release."""
    m = _manifests(ev)
    worst = lambda found: max(found, key=release.SEVERITY.__getitem__, default="PASS")
    scopes = {
        "invariants": worst(["BLOCK" if c != "invariant" else "PASS" for _, c, _ in P.invariants(m["A"], m["B"])]),
        "interventions": worst(["HOLD" if c in ("unexpected", "unknown") else "PASS" for c in release.interventions(*({k: v for k, v in m[r].items() if k in P.PROVENANCE} for r in "AB"), {"code_revision"}).values()]),
        "consistency": worst([P.encoder_consistency(x, False)[0] for x in m.values()]),
    }
    return ev.spark.createDataFrame([*scopes.items(), ("release", worst(list(scopes.values())))], "scope string, status string")


_WINDOW = """, sw AS (SELECT * FROM spans WHERE CAST(substr(query_id, 2) AS BIGINT) BETWEEN 40 AND 200)"""


@on("V", f"{_WINDOW} SELECT run_id, count(DISTINCT trace_id) AS traces, round(avg(CAST(output_capture = 'recorded' AS INT)) FILTER (status = 'FIRED'), 6) AS io, count(DISTINCT op_id) AS operators FROM sw GROUP BY 1")
def G10_evidence_profile(ev: Evidence) -> DataFrame:
    """Coverage of the traces within a run's window."""
    s = ev("spans").where(F.substring("query_id", 2, 20).cast("long").between(40, 200))
    io = F.avg(F.when(F.col("status") == "FIRED", (F.col("output_capture") == "recorded").cast("int")))
    return s.groupBy("run_id").agg(F.countDistinct("trace_id").alias("traces"), F.round(io, 6).alias("io"), F.countDistinct("op_id").alias("operators"))


@on("M", f"{_NORMAL} SELECT CASE max(CASE status WHEN 'PASS' THEN 0 WHEN 'HOLD' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END) WHEN 0 THEN 'PASS' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'FAIL' ELSE 'BLOCK' END AS decision, count(*) AS checks, count(*) FILTER (status = 'PASS') AS passed FROM cs")
def G11_release_audit(ev: Evidence) -> DataFrame:
    """The audit as an artifact, and what a reader of it finds."""
    checks = [r.asDict() for r in _checks(ev).select(*AT, "status", "reason").collect()]  # a row a check
    decision = max((c["status"] for c in checks), key=release.SEVERITY.__getitem__)
    read = json.loads(A.artifact("m", checks, decision))
    assert A.page(json.dumps(read)).count("<tr>") == len(read["checks"])
    return ev.spark.createDataFrame([(read["decision"], len(read["checks"]), sum(c["status"] == "PASS" for c in read["checks"]))], "decision string, checks bigint, passed bigint")


@on("V", f"{R._AGG}, rg AS (SELECT a.metric_name, a.mean AS x, b.mean AS y FROM ag a JOIN ag b ON a.pipeline_id = 'A' AND b.pipeline_id = 'B' AND a.stage_index = -1 AND b.stage_index = -1 AND a.metric_name = b.metric_name) SELECT count(*) FILTER (metric_name <> 'latency_ms' AND x - y > 0) + count(*) FILTER (metric_name = 'latency_ms' AND y > x * 1.1) AS worse FROM rg")
def G12_regression_assertion(ev: Evidence) -> DataFrame:
    """How many metrics of run B an assertion finds worse than those of run A."""
    a = R.aggregates(ev).where("stage_index = -1")
    worse = 0
    try:
        no_regression(a.where("pipeline_id = 'A'"), a.where("pipeline_id = 'B'"))
    except AssertionError as e:
        worse = str(e).count("->")
    return ev.spark.createDataFrame([(worse,)], "worse bigint")


@on("T", """, s AS (SELECT service_id, count(*) FILTER (op_id <> 'view') * 1e0 / count(*) AS label_coverage, count(*) FILTER (status = 'ERROR') * 1e0 / count(*) AS dropped FROM t_spans GROUP BY 1)
SELECT service_id, 'label_coverage' AS field, CASE WHEN label_coverage < 0.5 THEN 'HOLD' ELSE 'PASS' END AS status FROM s UNION ALL SELECT service_id, 'dropped', CASE WHEN dropped > 0.2 THEN 'HOLD' ELSE 'PASS' END FROM s""")
def G16_promotion_evidence(ev: Evidence) -> DataFrame:
    s = ev("t_spans").groupBy("service_id").agg((F.count_if(F.col("op_id") != "view") / F.count("*")).alias("label_coverage"), (F.count_if(F.col("status") == "ERROR") / F.count("*")).alias("dropped"))
    return A.thresholds(s, ["service_id"], {"label_coverage": 0.5}, {"dropped": 0.2})


@on("V", "SELECT run_id, f AS field, CASE f WHEN 'exit_reason' THEN 'HOLD' WHEN 'mapping' THEN 'BLOCK' ELSE 'PASS' END AS status FROM (SELECT DISTINCT run_id FROM spans), (VALUES ('identity'), ('document_identity'), ('io'), ('exit_reason'), ('mapping')) v(f)")
def G17_lineage_evidence(ev: Evidence) -> DataFrame:
    from evalquarry.operators import analysis as N

    c = N.lineage_coverage(ev("cands"), ev("spans")).withColumn("mapping", F.lit(None).cast("double"))
    return A.thresholds(c, ["run_id"], {"identity": 1.0, "document_identity": 1.0, "io": 0.5, "exit_reason": 0.999, "mapping": 0.9})


@on("V", """, p AS (SELECT run_id, avg(CAST(part AS INT)) AS partial, count(*) AS traces FROM (SELECT run_id, trace_id, bool_or(output_capture <> 'recorded') AS part FROM spans GROUP BY 1, 2) GROUP BY 1)
SELECT run_id, 'partial' AS field, CASE WHEN partial > 0.01 THEN 'HOLD' ELSE 'PASS' END AS status FROM p UNION ALL SELECT run_id, 'traces', CASE WHEN traces < 5 THEN 'HOLD' ELSE 'PASS' END FROM p""")
def G18_production_evidence(ev: Evidence) -> DataFrame:
    t = ev("spans").groupBy("run_id", "trace_id").agg(F.bool_or(F.col("output_capture") != "recorded").cast("int").alias("part"))
    return A.thresholds(t.groupBy("run_id").agg(F.avg("part").alias("partial"), F.count("*").alias("traces")), ["run_id"], {"traces": 5}, {"partial": 0.01})


@on("V", """, o AS (SELECT DISTINCT op_type FROM spans) SELECT 'dataset' AS item, 'ok' AS status UNION ALL SELECT op_type, 'ok' FROM o UNION ALL SELECT op_type || '.costs', CASE WHEN op_type IN ('SOURCE', 'RERANK') THEN 'ok' ELSE 'warning' END FROM o""")
def G19_config_report(ev: Evidence) -> DataFrame:
    kinds = sorted(r[0] for r in ev("spans").select("op_type").distinct().collect())  # operator types
    e = P.experiment(json.dumps({"name": "x", "dataset": {"name": "d"}, "pipelines": [{"id": k, "stages": [{"type": k}]} for k in kinds], "costs": {"SOURCE": 1, "RERANK": 5}}))
    return ev.spark.createDataFrame([x[:2] for x in P.report(e)], "item string, status string")


def _projection(ev: Evidence) -> RunStore:
    s, rows = RunStore(ev.spark, f"{shared_folder(ev.spark)}/evalquarry/runs-{uuid.uuid4().hex}"), E._rows(ev)
    for run in "AB":
        mine = rows.where(F.col("run_id") == run)
        s.project(run, f"digest-{run}", mine, V.summaries(mine))
    return s


@on("V", "SELECT run_id, count(DISTINCT query_id) AS queries, (SELECT count(*) FROM qrels) AS judgments, (SELECT sha256(string_agg(query_id || ' ' || doc_id || ' ' || grade, ',' ORDER BY query_id, doc_id)) FROM qrels) AS digest, 5 AS k FROM spans GROUP BY 1")
def I01_scope_resolve(ev: Evidence) -> DataFrame:
    """What an investigation is about: the run, its queries, and the judgments it is read with."""
    q = ev("qrels")
    digest = G.listed_digest(q.withColumn("line", F.concat("query_id", F.lit(" "), "doc_id", F.lit(" "), F.col("grade").cast("string"))), "query_id", "doc_id", "grade")
    j = q.agg(F.count("*").alias("judgments")).withColumn("digest", F.lit(digest).cast("string"))
    return ev("spans").groupBy("run_id").agg(F.countDistinct("query_id").alias("queries")).join(j, F.lit(True)).withColumn("k", F.lit(E.K))


@on("V", f"{R._SUMMARIES} SELECT run_id, kind, count(*) AS keys, sum(pairs) AS pairs FROM sm GROUP BY 1, 2")
def I02_projection_build(ev: Evidence) -> DataFrame:
    return _projection(ev).scan("summaries").groupBy("run_id", "kind").agg(F.count("*").alias("keys"), F.sum("pairs").alias("pairs"))


@on("V", "SELECT DISTINCT run_id, CASE run_id WHEN 'A' THEN 'complete' ELSE 'stale' END AS state FROM spans")
def I03_projection_state(ev: Evidence) -> DataFrame:
    return _projection(ev).projection_state(F.lit("digest-A"))


@on("V", f"""{E._ROWS}, pr AS (SELECT *, CASE outcome WHEN 'relevant_excluded' THEN CASE WHEN partial THEN 1 ELSE 0 END WHEN 'not_observed' THEN 0 WHEN 'insufficient_evidence' THEN 1 WHEN 'relevant_delivered' THEN 2 WHEN 'retained_below_cutoff' THEN 3 WHEN 'judged_nonrelevant' THEN 4 ELSE 5 END AS priority FROM jo WHERE run_id = 'A')
SELECT query_id, doc_id, priority, outcome FROM pr QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY priority, doc_id) BETWEEN 4 AND 8""")
def I04_list_documents(ev: Evidence) -> DataFrame:
    """The second page of each query's documents, what matters most first."""
    p = _projection(ev).projected("A", "digest-A")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", "doc_id"))
    return p.withColumn("place", place).where("place between 4 and 8").select("query_id", "doc_id", "priority", "outcome")


@on("V", f"{R._SUMMARIES} SELECT key AS query_id, pairs, delivered, excluded FROM sm WHERE kind = 'query' AND run_id = 'B'")
def I04_list_queries(ev: Evidence) -> DataFrame:
    return _projection(ev).scan("summaries", run_id="B", kind="query").select(F.col("key").alias("query_id"), "pairs", "delivered", "excluded")


@on("V", f"{E._AT} SELECT op_id, count(*) AS seen, count(*) FILTER (o) AS output, count(*) FILTER (r) AS removed FROM p WHERE run_id = 'A' GROUP BY 1")
def I05_flow(ev: Evidence) -> DataFrame:
    mine = _projection(ev).projected("A", "digest-A")
    one = lambda df: df.where("run_id = 'A'")
    return J.flow(one(ev("cands")), one(ev("spans")), mine, E.K).select("op_id", "seen", "output", "removed")


@on("V", f"{E._DIFF} SELECT change, alignment, count(*) AS pairs, count(*) FILTER (capture_limited) AS limited FROM df GROUP BY 1, 2")
def I08_compare(ev: Evidence) -> DataFrame:
    s = _projection(ev)
    d = J.journey_diff(s.projected("A", "digest-A"), s.projected("B", "digest-B"))
    return d.groupBy("change", "alignment").agg(F.count("*").alias("pairs"), F.count_if("capture_limited").alias("limited"))


@on("V", """, ck AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'alt' ELSE 'default' END AS namespace, concat('d', vec_id) AS entity FROM embeddings UNION ALL SELECT 'default', concat('d', vec_id) FROM embeddings WHERE vec_id % 8 = 0)
SELECT entity, min(namespace) AS namespace, concat('doc', CAST(substr(entity, 2) AS BIGINT) // 3) AS document_id FROM ck GROUP BY 1 HAVING count(DISTINCT namespace) = 1""")
def I09_entity_resolve(ev: Evidence) -> DataFrame:
    """A bare id means something if one namespace alone has it; a chunk stands for its document."""
    v = F.col("vec_id")
    rows = ev("embeddings").select(F.when(v % 4 == 0, "alt").otherwise("default").alias("namespace"), F.concat(F.lit("d"), v).alias("chunk_id"), F.concat(F.lit("doc"), F.floor(v / 3)).alias("document_id"))
    rows = rows.unionByName(rows.where(F.substring("chunk_id", 2, 20).cast("long") % 8 == 0).withColumn("namespace", F.lit("default")))
    from evalquarry.operators.judgments import only_namespace

    sure = only_namespace(rows)
    return sure.join(rows.select("chunk_id", "document_id").distinct(), "chunk_id").select(F.col("chunk_id").alias("entity"), "namespace", "document_id")


@on("V", "SELECT * FROM (VALUES (0, 'dense', 'SOURCE', 'FIRED', ''), (1, 'keep', 'FILTER', 'FIRED', 'dense'), (2, 'broken', 'TRANSFORM', 'ERROR', 'keep'), (3, 'route', 'GATE', 'FIRED', '')) v(span_idx, op_id, op_type, status, parents)")
def T04_trace_recorder(ev: Evidence) -> DataFrame:
    """Steps as spans: what fired, what failed, what was asked of a gate."""
    from evalquarry.catalog.retrieval import _lists

    trace = Recorder("X", rate=0.5)

    def broken(df: DataFrame) -> DataFrame:
        raise ValueError("no")

    with trace.scope():
        kept = trace.observe("FILTER", "keep")(lambda df: df.where("rank <= 3"))(trace.observe("SOURCE", "dense")(lambda: _lists(ev, "dense"))())
        try:
            trace.observe("TRANSFORM", "broken")(broken)(kept)
        except ValueError:
            pass
        with trace.gate("route", ["rerank", "fast"]) as gate:
            gate["route"] = "fast"
    return ev.spark.createDataFrame([(s["span_idx"], s["op_id"], s["op_type"], s["status"], s["parents"]) for s in trace.spans()], "span_idx int, op_id string, op_type string, status string, parents string")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', qid + n) AS doc_id, CAST(n AS INT) AS rank FROM v_q, range(1, 4) r(n)")
def T09_output_extraction(ev: Evidence) -> DataFrame:
    """Results of several shapes: a mapping that holds documents, pairs with scores, plain ids."""
    def call(query_id: str, text: str, k: int) -> object:
        q = int(query_id[1:])
        ids = [f"d{q + n}" for n in range(1, k + 1)]
        return {"documents": [{"metadata": {"id": i}} for i in ids]} if q % 60 == 0 else [(i, 1.0) for i in ids] if q % 60 == 20 else ids

    q = ev("v_q").select(F.concat(F.lit("q"), "qid").alias("query_id"), F.lit("").alias("text"))
    return external.retrieve(q, call, 3).select("query_id", "doc_id", "rank")

"""Queries of pipelines: graphs, runners, adapters and the evaluation of a run (bindings V, L and T)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence, similarity
from evalquarry.catalog import evidence as E
from evalquarry.catalog import retrieval as C
from evalquarry.functions import identity as I
from evalquarry.operators import diagnostics as D
from evalquarry.operators import retrieval as R
from evalquarry.plans import evaluate as V
from evalquarry.plans import graph as G
from evalquarry.plans.observe import Recorder
from evalquarry.plans.storage import shared_folder
from evalquarry.registry import on
from evalquarry.sources import external



def _n(c: str):  # noqa: ANN202
    return F.substring(c, 2, 20).cast("long")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(rank AS INT) AS rank FROM (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY -abs(qid - did) DESC, rank) AS rank FROM v_dense) WHERE rank <= 10")
def R07_cross_encoder(ev: Evidence) -> DataFrame:
    """A function stands for the model: nearer numbers score higher."""
    c = C._lists(ev, "dense").select("query_id", "doc_id", F.col("query_id").alias("query_text"), F.col("doc_id").alias("text"), "rank")
    return external.scored(c, lambda q, d: [-float(abs(int(a[1:]) - int(b[1:]))) for a, b in zip(q, d, strict=True)], 10).select("query_id", "doc_id", "rank")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(51 - rank AS INT) AS rank FROM v_dense WHERE rank > 45")
def R08_remote_rerank(ev: Evidence) -> DataFrame:
    """A service that takes a list and returns it turned round, with scores."""
    return external.reranked(C._lists(ev, "dense"), lambda q, docs: [(d, float(i)) for i, d in reversed(list(enumerate(docs)))], 5).select("query_id", "doc_id", "rank")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM v_dense WHERE did % 2 = 0")
def R13_transform(ev: Evidence) -> DataFrame:
    return R.transform(C._lists(ev, "dense"), lambda c: R.keep(c, _n("doc_id") % 2 == 0)).select("query_id", "doc_id", "rank")


@on("V", "SELECT concat('q', qid) AS query_id, string_agg(concat('d', did), ' ' ORDER BY rank) AS answer FROM v_dense WHERE rank <= 3 GROUP BY 1")
def R14_generate(ev: Evidence) -> DataFrame:
    """A generator over the first candidates; here it lists them."""
    top = C._lists(ev, "dense").where("rank <= 3")
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]), " ").alias("answer"))


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, rank FROM v_lex WHERE rank <= 7")
def R15_named_executor(ev: Evidence) -> DataFrame:
    """An operator by name; the node's k overrides the query's."""
    named = {"first": lambda inputs, params: inputs[0].where(F.col("rank") <= params.get("k", 10))}
    nodes = G.parse([{"id": "lexical", "type": "SOURCE", "params": {"operator": "lexical"}}, {"id": "cut", "type": "TRANSFORM", "inputs": ["lexical"], "params": {"operator": "first", "k": 7}}])
    return G.run(nodes, named | {"lexical": lambda inputs, params: C._lists(ev, "lexical")})["cut"].select("query_id", "doc_id", "rank")


def _registry(ev: Evidence) -> dict:
    def rerank(inputs: list[DataFrame], params: dict) -> DataFrame:
        c = similarity(ev, inputs[0].select("query_id", "doc_id", _n("query_id").alias("qid"), _n("doc_id").alias("did")))
        return R.ranked(c.select("query_id", "doc_id", F.col("s").alias("score")), F.desc("score"), _n("doc_id"), top_k=params.get("k"))

    return {
        "dense": lambda inputs, params: C._lists(ev, "dense", "B"), "lexical": lambda inputs, params: C._lists(ev, "lexical", "B"),
        "FUSE": lambda inputs, params: R.fuse(inputs, top_k=params.get("top_k")), "RERANK": rerank,
    }


_GRAPH = [
    {"id": "dense", "type": "SOURCE", "params": {"operator": "dense"}}, {"id": "lexical", "type": "SOURCE", "params": {"operator": "lexical"}},
    {"id": "fuse", "type": "FUSE", "inputs": ["dense", "lexical"], "params": {"top_k": 30}}, {"id": "rerank", "type": "RERANK", "inputs": ["fuse"], "params": {"k": 10}},
]


@on("V", "SELECT * FROM (SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, s AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS INT) AS rank FROM v_fuse WHERE run_id = 'B') WHERE rank <= 10")
def R16_dag_run(ev: Evidence) -> DataFrame:
    return G.run(G.parse(_GRAPH), _registry(ev))["rerank"].select("query_id", "doc_id", "score", "rank")


_DEPTH = """, e AS (SELECT DISTINCT run_id, op_id, unnest(string_split(parents, ',')) AS parent FROM spans), d0 AS (SELECT DISTINCT run_id, op_id, 0 AS d FROM e WHERE parent = ''),
d1 AS (SELECT e.run_id, e.op_id, 1 AS d FROM e JOIN d0 ON d0.run_id = e.run_id AND d0.op_id = e.parent), d2 AS (SELECT e.run_id, e.op_id, 2 AS d FROM e JOIN d1 ON d1.run_id = e.run_id AND d1.op_id = e.parent),
d3 AS (SELECT e.run_id, e.op_id, 3 AS d FROM e JOIN d2 ON d2.run_id = e.run_id AND d2.op_id = e.parent), d4 AS (SELECT e.run_id, e.op_id, 4 AS d FROM e JOIN d3 ON d3.run_id = e.run_id AND d3.op_id = e.parent),
d5 AS (SELECT e.run_id, e.op_id, 5 AS d FROM e JOIN d4 ON d4.run_id = e.run_id AND d4.op_id = e.parent), d6 AS (SELECT e.run_id, e.op_id, 6 AS d FROM e JOIN d5 ON d5.run_id = e.run_id AND d5.op_id = e.parent),
dp AS (SELECT run_id, op_id, CAST(max(d) AS INT) AS stage FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6) GROUP BY 1, 2),
lay AS (SELECT run_id, op_id, stage, CASE WHEN count(*) OVER (PARTITION BY run_id, stage) > 1 THEN op_id ELSE '' END AS branch FROM dp)"""


def _nodes(ev: Evidence) -> dict[str, list[G.Node]]:
    """The operator graph of each run, from its spans (tens of operators)."""
    out: dict[str, list[G.Node]] = {}
    for r in ev("spans").select("run_id", "span_idx", "op_id", "op_type", "parents").distinct().orderBy("run_id", "span_idx").collect():
        out.setdefault(r["run_id"], []).append(G.Node(r["op_id"], r["op_type"], tuple(p for p in r["parents"].split(",") if p)))
    return out


def layout(ev: Evidence) -> DataFrame:
    rows = [(run, op, stage, branch or "") for run, nodes in _nodes(ev).items() for op, (stage, branch) in G.layout(nodes).items()]
    return ev.spark.createDataFrame(rows, "run_id string, op_id string, stage int, branch string")


@on("V", f"{_DEPTH} SELECT run_id, op_id, stage FROM dp")
def R17_execution_waves(ev: Evidence) -> DataFrame:
    rows = [(run, op, d) for run, nodes in _nodes(ev).items() for op, d in G.depths(nodes).items()]
    return ev.spark.createDataFrame(rows, "run_id string, op_id string, stage int")


@on("V", f"{_DEPTH} SELECT * FROM lay")
def A04_union_layout(ev: Evidence) -> DataFrame:
    return layout(ev)


@on("V", f"{_DEPTH} SELECT op_id, stage, branch, count(*) AS runs FROM lay GROUP BY 1, 2, 3")
def G04_operator_depths(ev: Evidence) -> DataFrame:
    return layout(ev).groupBy("op_id", "stage", "branch").agg(F.count("*").alias("runs"))


@on("T", "SELECT event_id, CAST(event_id AS VARCHAR) AS candidate_id FROM t_spans")
def R20_candidate_coercion(ev: Evidence) -> DataFrame:
    """Items of several shapes as JSON; an item without an id is an error."""
    t, i = ev("t_spans"), F.col("event_id").cast("string")
    item = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(i.alias("doc_id")))).when(F.col("event_id") % 4 == 1, F.to_json(F.struct(i.alias("id")))).when(F.col("event_id") % 4 == 2, F.to_json(F.struct(F.struct(i.alias("id")).alias("metadata")))).otherwise(F.to_json(F.struct(F.struct(i.alias("node_id")).alias("node"))))
    return t.select("event_id", R.coerced(item).alias("candidate_id"))


@on("V", "SELECT query_id, CASE WHEN latency_ms > 40 THEN 'TIMEOUT' ELSE 'OK' END AS status, CASE WHEN latency_ms > 40 THEN 0 ELSE 5 END AS candidates FROM spans WHERE op_id = 'dense' AND run_id = 'A'")
def R21_single_stage(ev: Evidence) -> DataFrame:
    """One source with its own k; a query beyond its deadline has a status and no list."""
    s = ev("spans").where("op_id = 'dense' and run_id = 'A'").select("query_id", F.when(F.col("latency_ms") > 40, "TIMEOUT").otherwise("OK").alias("status"))
    got = C._lists(ev, "dense").where("rank <= 5").groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    return s.join(got, "query_id", "left").select("query_id", "status", F.when(F.col("status") == "OK", F.coalesce("n", F.lit(0))).otherwise(0).alias("candidates"))


@on("V", """, a AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY did) AS rank FROM v_dense), b AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY did DESC) AS rank FROM a WHERE rank <= 20)
SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(rank AS INT) AS rank FROM b WHERE rank <= 5""")
def R22_multi_stage(ev: Evidence) -> DataFrame:
    one = R.rerank(C._lists(ev, "dense"), -_n("doc_id").cast("double"), top_k=20)
    return R.rerank(one, _n("doc_id").cast("double"), top_k=5).select("query_id", "doc_id", "rank")


@on("V", f"""{_DEPTH} SELECT l.run_id, l.op_id, s.op_type, l.stage, count(DISTINCT e.parent) FILTER (e.parent <> '') AS inputs FROM lay l JOIN (SELECT DISTINCT run_id, op_id, op_type FROM spans) s USING (run_id, op_id) JOIN e USING (run_id, op_id) GROUP BY 1, 2, 3, 4""")
def R23_graph_parse(ev: Evidence) -> DataFrame:
    rows = []
    for run, nodes in _nodes(ev).items():
        parsed = G.parse([{"id": n.id, "type": n.type, "inputs": list(n.inputs)} for n in nodes])
        at = G.depths(parsed)
        rows += [(run, n.id, n.type, at[n.id], len(n.inputs)) for n in parsed]
    return ev.spark.createDataFrame(rows, "run_id string, op_id string, op_type string, stage int, inputs bigint")


@on("V", """, p AS (SELECT DISTINCT run_id, unnest(string_split(parents, ',')) AS op_id FROM spans) SELECT DISTINCT s.run_id, s.op_id AS without, p.op_id IS NULL AS runs FROM spans s LEFT JOIN p ON p.run_id = s.run_id AND p.op_id = s.op_id""")
def R24_graph_validate(ev: Evidence) -> DataFrame:
    """Each run's graph without one of its operators: what someone reads can't be left out."""
    rows = []
    for run, nodes in _nodes(ev).items():
        for gone in nodes:
            try:
                G.check([n for n in nodes if n.id != gone.id])
                rows.append((run, gone.id, True))
            except G.GraphError:
                rows.append((run, gone.id, False))
    return ev.spark.createDataFrame(rows, "run_id string, without string, runs boolean")


@on("V", """, o AS (SELECT op_id, min(span_idx) AS i FROM spans WHERE run_id = 'A' AND op_type <> 'SOURCE' GROUP BY 1), s AS (SELECT op_id, row_number() OVER (ORDER BY i) - 1 AS i FROM o)
SELECT string_agg(op_id, '__' ORDER BY i) AS pipeline, count(*) AS stages FROM range(1, 128) r(m), s WHERE (m >> i) & 1 = 1 GROUP BY m""")
def R25_ablation_expansion(ev: Evidence) -> DataFrame:
    stages = [n.id for n in _nodes(ev)["A"] if n.type != "SOURCE"]
    return ev.spark.createDataFrame([(k, len(v)) for k, v in G.ablations(stages).items()], "pipeline string, stages bigint")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(rank AS INT) AS rank FROM v_dense WHERE rank <= 4")
def R26_adapter_factory(ev: Evidence) -> DataFrame:
    external.REGISTRY["listed"] = lambda ev_, k: C._lists(ev_, "dense").where(F.col("rank") <= k)
    return external.REGISTRY["listed"](ev, 4).select("query_id", "doc_id", "rank")


@on("V", """SELECT DISTINCT op_id, CASE WHEN op_id = 'fuse' THEN 'FUSE' WHEN parents = '' THEN 'SOURCE' WHEN op_id = 'rerank' THEN 'RERANK' ELSE 'TRANSFORM' END AS op_type FROM spans""")
def R41_graph_type_inference(ev: Evidence) -> DataFrame:
    raw = [{"id": n.id, "inputs": list(n.inputs), "fuse": n.id == "fuse", "reranker": n.id == "rerank"} for n in _nodes(ev)["A"]]
    return ev.spark.createDataFrame([(n["id"], G.infer_type(n)) for n in raw], "op_id string, op_type string")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(rank AS INT) AS rank FROM v_fuse WHERE run_id = 'B' AND rank <= 12")
def R27_dag_factory(ev: Evidence) -> DataFrame:
    """Nodes without types, inferred and run."""
    raw = [{"id": "a", "params": {"operator": "dense"}}, {"id": "b", "params": {"operator": "lexical"}}, {"id": "c", "inputs": ["a", "b"], "fuse": "rrf", "params": {"top_k": 12}}]
    return G.run(G.parse(raw), _registry(ev))["c"].select("query_id", "doc_id", "rank")


@on("V", """, a AS (SELECT qid, did, rank FROM v_dense UNION ALL SELECT qid, did, rank FROM v_lex), f AS (SELECT qid, did, round(sum(1e0 / (60 + rank)), 9) AS score FROM a GROUP BY 1, 2)
SELECT * FROM (SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, concat('d', did)) AS INT) AS rank FROM f) WHERE rank <= 20""")
def R29_fuse_marker(ev: Evidence) -> DataFrame:
    return G.fused(["dense", "lexical"], top_k=20)(_registry(ev)).select("query_id", "doc_id", "rank")


_LINE = """, st AS (SELECT query_id, op_id, doc_id, rank, CASE op_id WHEN 'lexical' THEN 0 WHEN 'filter' THEN 1 ELSE 2 END AS stage FROM cands WHERE side = 'out' AND run_id = 'A' AND op_id IN ('lexical', 'filter', 'fuse'))"""


@on("V", f"{_LINE} SELECT a.query_id, a.op_id, a.doc_id, a.rank, coalesce(b.rank, 0) AS input_rank, CASE a.stage WHEN 1 THEN 'lexical' WHEN 2 THEN 'filter' ELSE '' END AS parent_op_id FROM st a LEFT JOIN st b ON b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.stage = a.stage - 1")
def R30_linear_trace(ev: Evidence) -> DataFrame:
    stage = F.when(F.col("op_id") == "lexical", 0).when(F.col("op_id") == "filter", 1).otherwise(2)
    st = ev("cands").where("side = 'out' and run_id = 'A' and op_id in ('lexical', 'filter', 'fuse')").select("query_id", stage.alias("stage"), "op_id", "doc_id", "rank")
    return V.linear(st).select("query_id", "op_id", "doc_id", "rank", F.coalesce("input_rank", F.lit(0)).alias("input_rank"), F.coalesce("parent_op_id", F.lit("")).alias("parent_op_id"))


@on("V", ", q AS (SELECT DISTINCT query_id FROM spans), p AS (SELECT DISTINCT run_id FROM spans) SELECT run_id AS pipeline_id, query_id, md5('7|' || run_id || '|' || query_id) AS turn FROM q, p")
def R31_run_schedule(ev: Evidence) -> DataFrame:
    s = ev("spans")
    return V.schedule(s.select(F.col("run_id").alias("pipeline_id")).distinct(), s.select("query_id").distinct(), 7)


@on("T", """SELECT op_id AS pipeline_id, CAST(event_id AS VARCHAR) AS query_id, CASE WHEN event_id % 7 = 0 THEN 'TIMEOUT' WHEN event_id % 5 = 0 THEN 'ERROR' ELSE 'OK' END AS status,
  CAST(CASE WHEN event_id % 7 = 0 THEN 1 WHEN event_id % 5 = 0 THEN 3 ELSE 1 END AS INT) AS attempts FROM t_spans""")
def R32_benchmark_runner(ev: Evidence) -> DataFrame:
    def call(pipeline: str, query: str) -> str:
        if int(query) % 7 == 0:
            raise TimeoutError("too late")
        if int(query) % 5 == 0:
            raise ValueError("broken")
        return query

    return V.run_tasks(ev("t_spans").select(F.col("op_id").alias("pipeline_id"), F.col("event_id").cast("string").alias("query_id")), call, tries=3)


@on("L", "SELECT item_id, sha256('cfg::dataset:bench:nocorpus::' || item_id || '::' || text) AS key FROM benchmark")
def R33_result_cache_key(ev: Evidence) -> DataFrame:
    dataset = I.dataset_identity(F.lit("bench"), F.lit(None).cast("string"))
    return ev("benchmark").select("item_id", I.cache_key(F.lit("cfg"), dataset, F.col("item_id").cast("string"), F.col("text")).alias("key"))


@on("V", "SELECT query_id, left(sha256(string_agg(doc_id, ',' ORDER BY doc_id)), 16) AS upstream FROM cands WHERE op_id = 'fuse' AND side = 'out' AND run_id = 'A' GROUP BY 1")
def R34_stage_cache_key(ev: Evidence) -> DataFrame:
    return C._lists(ev, "fuse").groupBy("query_id").agg(I.upstream_key(F.collect_list("doc_id")).alias("upstream"))


_ACCOUNT = """, ex AS (SELECT DISTINCT run_id, query_id FROM spans WHERE CAST(substr(query_id, 2) AS BIGINT) % 80 <> 0),
re AS (SELECT DISTINCT run_id, query_id, 1 AS c FROM spans WHERE CAST(substr(query_id, 2) AS BIGINT) % 60 <> 0 UNION ALL SELECT DISTINCT run_id, query_id, 2 FROM spans WHERE CAST(substr(query_id, 2) AS BIGINT) % 100 = 20),
g AS (SELECT coalesce(ex.run_id, r.run_id) AS run_id, ex.query_id AS e, r.n FROM ex FULL JOIN (SELECT run_id, query_id, count(*) AS n FROM re GROUP BY 1, 2) r ON r.run_id = ex.run_id AND r.query_id = ex.query_id)"""


@on("V", f"{_ACCOUNT} SELECT run_id, count(e) AS expected, coalesce(sum(n), 0) AS recorded, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (e IS NULL) AS strays, count(*) FILTER (n IS NULL) AS missing FROM g GROUP BY 1")
def R35_trace_accounting(ev: Evidence) -> DataFrame:
    t = ev("spans").select("run_id", "query_id").distinct()
    return V.accounting(t.where(_n("query_id") % 80 != 0), t.where(_n("query_id") % 60 != 0).unionByName(t.where(_n("query_id") % 100 == 20)))


def _evaluated(ev: Evidence):  # noqa: ANN202
    corpus = ev("embeddings").where("vec_id % 13 <> 5").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    return V.evaluate(ev.spark, f"{shared_folder(ev.spark)}/evalquarry/eval-{uuid.uuid4().hex}", ev("cands"), ev("spans"), ev("qrels"), corpus)


@on("V", f"{C._LONG} SELECT run_id, op_id, metric_name, k, count(*) AS n, round(avg(value), 6) AS mean FROM long GROUP BY 1, 2, 3, 4")
def R35_evaluate_metrics(ev: Evidence) -> DataFrame:
    rows = _evaluated(ev).scan("metrics")
    return rows.groupBy("run_id", F.col("pipeline_id").alias("op_id"), "metric_name", "k").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@on("V", f"{E._RULES} SELECT left(trace_id, 1) AS run_id, label, availability, count(*) AS n FROM fin GROUP BY 1, 2, 3")
def R35_evaluate_findings(ev: Evidence) -> DataFrame:
    return _evaluated(ev).scan("findings").groupBy("run_id", "label", "availability").agg(F.count("*").alias("n"))


@on("V", f"{E._ROWS} SELECT run_id, outcome, count(*) AS pairs FROM jo GROUP BY 1, 2")
def R35_evaluate_projection(ev: Evidence) -> DataFrame:
    s = _evaluated(ev)
    return s.projected("A", "d0").unionByName(s.projected("B", "d0")).groupBy("run_id", "outcome").agg(F.count("*").alias("pairs"))


@on("V", """, f AS (SELECT DISTINCT query_id, doc_id FROM cands WHERE op_id = 'select' AND side = 'out' AND run_id = 'A')
SELECT f.query_id, f.doc_id, CAST(CAST(substr(f.doc_id, 2) AS BIGINT) % 3 AS INT) AS grade FROM f LEFT JOIN qrels q ON q.query_id = f.query_id AND q.doc_id = f.doc_id WHERE q.grade IS NULL""")
def R37_judge_pooling(ev: Evidence) -> DataFrame:
    """Final candidates without a grade go to a judge; here its answer says their number's remainder."""
    pool = ev("cands").where("op_id = 'select' and side = 'out' and run_id = 'A'").select("query_id", "doc_id").distinct().join(ev("qrels"), ["query_id", "doc_id"], "left_anti")
    return external.judged(pool, lambda q, d: f"Grade: {int(d[1:]) % 3}, I think", external.first_grade)


@on("V", """, s AS (SELECT DISTINCT op_id, span_idx, CASE WHEN op_id IN ('fast', 'select') THEN NULL ELSE op_type END AS declared FROM spans WHERE run_id = 'A'), n AS (SELECT *, span_idx % 4 AS stage FROM s)
SELECT op_id, CASE WHEN declared = 'FUSE' AND stage = 0 THEN 'SOURCE' WHEN declared IS NOT NULL THEN declared WHEN stage = 0 THEN 'SOURCE' ELSE 'TRANSFORM' END AS op_type FROM n""")
def R40_stage_type_inference(ev: Evidence) -> DataFrame:
    s = ev("spans").where("run_id = 'A'").select("op_id", "span_idx", F.when(~F.col("op_id").isin("fast", "select"), F.col("op_type")).alias("declared")).distinct()
    return s.select("op_id", V.operator_type(F.col("declared"), F.col("span_idx") % 4).alias("op_type"))


@on("T", "SELECT event_id, CASE WHEN n = 1 THEN op_id ELSE op_id || '#' || n END AS node FROM (SELECT *, row_number() OVER (PARTITION BY service_id, op_id ORDER BY event_id) AS n FROM t_spans)")
def R42_node_numbering(ev: Evidence) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("service_id", "op_id").orderBy("event_id"))
    return ev("t_spans").withColumn("n", n).select("event_id", F.when(F.col("n") == 1, F.col("op_id")).otherwise(F.concat("op_id", F.lit("#"), F.col("n").cast("string"))).alias("node"))


@on("V", """SELECT run_id, count(*) FILTER (coalesce(candidate_id, '') = '') AS without_id, count(*) FILTER (parent_candidate_id = candidate_id) AS own_parent,
  count(*) FILTER (op_id = 'expand' AND side = 'out' AND CAST(substr(candidate_id, 2) AS BIGINT) >= 100000 AND parent_candidate_id IS NULL) AS orphans, count(parent_candidate_id) AS derived FROM cands GROUP BY 1""")
def R45_candidate_invariants(ev: Evidence) -> DataFrame:
    made = (F.col("op_id") == "expand") & (F.col("side") == "out") & (F.substring("candidate_id", 2, 20).cast("long") >= 100000)
    return ev("cands").groupBy("run_id").agg(
        F.count_if(F.coalesce("candidate_id", F.lit("")) == "").alias("without_id"), F.count_if(F.col("parent_candidate_id") == F.col("candidate_id")).alias("own_parent"),
        F.count_if(made & F.col("parent_candidate_id").isNull()).alias("orphans"), F.count("parent_candidate_id").alias("derived"))


@on("V", """, q AS (SELECT query_id FROM (SELECT DISTINCT query_id FROM qrels) ORDER BY query_id LIMIT 5), h AS (SELECT q.query_id, count(*) AS n FROM q JOIN cands c ON c.query_id = q.query_id AND c.op_id = 'dense' AND c.side = 'out' AND c.run_id = 'A'
  JOIN embeddings e ON concat('d', e.vec_id) = c.doc_id GROUP BY 1) SELECT (SELECT count(*) FROM q) AS queries, count(*) AS with_hits, sum(n) AS hits, count(*) > 0 AS consistent FROM h""")
def R46_id_consistency(ev: Evidence) -> DataFrame:
    """The smoke test: the first five queries must find documents of the corpus at the first stage."""
    q = ev("qrels").select("query_id").distinct().orderBy("query_id").limit(5)
    corpus = ev("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    hits = C._lists(ev, "dense").join(q, "query_id", "left_semi").join(corpus, "doc_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return q.agg(F.count("*").alias("queries")).join(hits.agg(F.count("*").alias("with_hits"), F.sum("n").alias("hits"), (F.count("*") > 0).alias("consistent")), F.lit(True))


@on("V", """SELECT q.query_id, CASE WHEN e.vec_id % 4 = 0 THEN 'alt' ELSE 'default' END AS namespace, q.doc_id AS entity_id, q.grade FROM qrels q JOIN embeddings e ON concat('d', e.vec_id) = q.doc_id""")
def R47_chunk_map_judgments(ev: Evidence) -> DataFrame:
    """Gold judgments in the namespace of the chunk map."""
    from evalquarry.catalog.more import _chunks
    from evalquarry.operators.judgments import in_namespace

    return in_namespace(ev("qrels"), _chunks(ev))


@on("V", "SELECT 'dense' AS op_id, 'out' AS side, '' AS parent, count(*) AS n FROM v_dense UNION ALL SELECT 'even', 'in', 'dense', count(*) FROM v_dense UNION ALL SELECT 'even', 'out', '', count(*) FROM v_dense WHERE did % 2 = 0 UNION ALL SELECT 'even#2', 'in', 'even', count(*) FROM v_dense WHERE did % 2 = 0 UNION ALL SELECT 'even#2', 'out', '', count(*) FROM v_dense WHERE did % 2 = 0")
def T05_observed_steps(ev: Evidence) -> DataFrame:
    trace = Recorder("X")
    even = trace.observe("FILTER", "even")(lambda df: df.where(_n("doc_id") % 2 == 0))
    with trace.scope():
        even(even(trace.observe("SOURCE", "dense")(lambda: C._lists(ev, "dense"))()))
    return trace.cands().groupBy("op_id", "side", F.coalesce("parent_op_id", F.lit("")).alias("parent")).agg(F.count("*").alias("n"))


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', qid + n) AS doc_id, CAST(n AS INT) AS rank FROM v_q, range(1, 4) r(n)")
def U01_function_retriever(ev: Evidence) -> DataFrame:
    @external.retriever("neighbours")
    def neighbours(query_id: str, text: str, k: int) -> list[str]:
        return [f"d{int(query_id[1:]) + n}" for n in range(1, 10)]

    q = ev("v_q").select(F.concat(F.lit("q"), "qid").alias("query_id"), F.lit("").alias("text"))
    return external.retrieve(q, external.REGISTRY["neighbours"], 3).select("query_id", "doc_id", "rank")


@on("V", f"{E._RULES} SELECT trace_id, 'shallow_miss' AS label, count(*) AS n FROM sp JOIN rl USING (trace_id, doc_id) WHERE is_final AND side = 'out' AND rank > 3 GROUP BY 1")
def U06_custom_rule(ev: Evidence) -> DataFrame:
    """A rule of one's own: a function of the context that returns findings."""
    def shallow_miss(c) -> DataFrame:  # noqa: ANN001
        low = c.side("out", "is_final").join(c.cands.where("side = 'out' and rank > 3"), ["trace_id", "op_id", "doc_id"], "left_semi")
        return c.findings("shallow_miss", low.join(c.relevant, ["trace_id", "doc_id"], "left_semi"), None)

    return D.evaluate(E._context(ev), (shallow_miss,)).where("availability = 'supported'").select("trace_id", "label", F.col("n_documents").alias("n"))


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank DESC) AS INT) AS rank FROM v_dense")
def U07_custom_executor(ev: Evidence) -> DataFrame:
    nodes = G.parse([{"id": "s", "type": "SOURCE", "params": {"operator": "dense"}}, {"id": "t", "type": "TRANSFORM", "inputs": ["s"], "params": {"operator": "turned"}}])
    turned = lambda inputs, params: R.rerank(inputs[0], F.col("rank").cast("double"))
    return G.run(nodes, _registry(ev) | {"turned": turned})["t"].select("query_id", "doc_id", "rank")

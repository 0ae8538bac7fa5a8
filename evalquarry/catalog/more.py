"""Queries of judgments, lineage, alignment and pages (bindings V, L and M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.operators import comparison as C
from evalquarry.operators import judgments as G
from evalquarry.operators import analysis as N
from evalquarry.registry import on
from evalquarry.sources import store

_CHUNKS = """, ck AS (SELECT CASE WHEN vec_id % 4 = 0 THEN 'alt' ELSE 'default' END AS namespace, concat('d', vec_id) AS chunk_id, concat('doc', vec_id // 3) AS document_id FROM embeddings),
cd AS (SELECT c.query_id, c.doc_id, c.rank, CASE WHEN CAST(substr(c.doc_id, 2) AS BIGINT) % 4 = 0 THEN 'alt' ELSE 'default' END AS namespace, CASE WHEN CAST(substr(c.doc_id, 2) AS BIGINT) % 10 = 7 THEN 'fixed' END AS document_id
  FROM cands c WHERE run_id = 'A' AND op_id = 'dense' AND side = 'out'),
dv AS (SELECT cd.*, coalesce(cd.document_id, ck.document_id, cd.doc_id) AS document FROM cd LEFT JOIN ck ON ck.namespace = cd.namespace AND ck.chunk_id = cd.doc_id AND CAST(substr(cd.doc_id, 2) AS BIGINT) % 5 <> 0)"""


def _chunks(ev: Evidence) -> DataFrame:
    v = F.col("vec_id")
    return ev("embeddings").select(F.when(v % 4 == 0, "alt").otherwise("default").alias("namespace"), F.concat(F.lit("d"), v).alias("chunk_id"), F.concat(F.lit("doc"), F.floor(v / 3)).alias("document_id"))


def _documents(ev: Evidence) -> DataFrame:
    n = F.substring("doc_id", 2, 20).cast("long")
    c = ev("cands").where("run_id = 'A' and op_id = 'dense' and side = 'out'").select("query_id", "doc_id", "rank", F.when(n % 4 == 0, "alt").otherwise("default").alias("namespace"), F.when(n % 10 == 7, "fixed").alias("document_id"))
    return G.document_of(c, _chunks(ev).where(F.substring("chunk_id", 2, 20).cast("long") % 5 != 0))


@on("V", f"{_CHUNKS} SELECT query_id, doc_id, document FROM dv")
def J10_document_of_candidate(ev: Evidence) -> DataFrame:
    return _documents(ev).select("query_id", "doc_id", "document")


@on("V", f"{_CHUNKS} SELECT chunk_id, namespace FROM ck")
def J11_chunk_namespace(ev: Evidence) -> DataFrame:
    c = _chunks(ev)
    return G.only_namespace(c).select("chunk_id", "namespace")


_JUDGED = f"""{_CHUNKS}, jd AS (SELECT query_id, doc_id AS entity_id, grade FROM qrels UNION ALL SELECT query_id, 'doc5', 3 FROM (SELECT DISTINCT query_id FROM qrels)),
ja AS (SELECT dv.query_id, dv.doc_id, CASE WHEN p.grade IS NULL AND o.grade IS NOT NULL THEN dv.doc_id ELSE dv.document END AS entity, coalesce(p.grade, o.grade) AS grade
  FROM dv LEFT JOIN jd p ON p.query_id = dv.query_id AND p.entity_id = dv.document LEFT JOIN jd o ON o.query_id = dv.query_id AND o.entity_id = dv.doc_id)"""


def _judged(ev: Evidence) -> DataFrame:
    q = ev("qrels")
    j = q.select("query_id", F.lit("default").alias("namespace"), F.col("doc_id").alias("entity_id"), "grade")
    j = j.union(q.select("query_id").distinct().select("query_id", F.lit("default"), F.lit("doc5"), F.lit(3)))
    return G.judged_as(_documents(ev), j)


@on("V", f"{_JUDGED} SELECT query_id, doc_id, entity, grade FROM ja")
def J09_judged_document(ev: Evidence) -> DataFrame:
    return _judged(ev).select("query_id", "doc_id", "entity", "grade")


@on("V", f"{_JUDGED} SELECT CASE WHEN grade IS NULL THEN 'unknown' WHEN grade >= 1 THEN 'relevant' ELSE 'nonrelevant' END AS relevance, count(*) AS n FROM ja GROUP BY 1")
def J08_relevance(ev: Evidence) -> DataFrame:
    return _judged(ev).groupBy(G.relevance(F.col("grade")).alias("relevance")).agg(F.count("*").alias("n"))


@on("V", f"{_CHUNKS} SELECT query_id, document AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), document) AS rank FROM dv GROUP BY 1, 2")
def R36_document_view(ev: Evidence) -> DataFrame:
    return G.document_view(_documents(ev), "document")


@on("V", f"{_CHUNKS} SELECT query_id, document, min(rank) <= 10 AS included FROM dv GROUP BY 1, 2")
def J12_any_chunk_inclusion(ev: Evidence) -> DataFrame:
    return _documents(ev).groupBy("query_id", "document").agg(F.bool_or(F.col("rank") <= 10).alias("included"))


@on("V", """, ms AS (SELECT DISTINCT doc_id FROM qrels WHERE CAST(substr(doc_id, 2) AS BIGINT) % 13 = 5), f AS (SELECT string_agg(doc_id, ',' ORDER BY doc_id) AS s FROM (SELECT doc_id FROM ms ORDER BY doc_id LIMIT 10))
SELECT (SELECT count(DISTINCT query_id) FROM qrels) AS queries, (SELECT count(*) FROM embeddings WHERE vec_id % 13 <> 5) AS documents, (SELECT count(*) FROM qrels) AS judgments, (SELECT count(*) FROM ms) AS missing, (SELECT s FROM f) AS first_missing,
  round(100e0 * (1 - (SELECT count(*) FROM qrels) * 1e0 / ((SELECT count(DISTINCT query_id) FROM qrels) * (SELECT count(*) FROM embeddings WHERE vec_id % 13 <> 5))), 4) AS sparsity_pct""")  # fmt: skip
def A33_dataset_fingerprint(ev: Evidence) -> DataFrame:
    corpus = ev("embeddings").where("vec_id % 13 <> 5").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    return G.fingerprint(ev("qrels"), corpus, ev("qrels"))


@on("L")
def F26_content_hash(ev: Evidence) -> DataFrame:
    return G.content_hash(ev("benchmark"), "item_id", "text")


@on("V", "SELECT run_id, trace_id, sum(CASE WHEN status = 'FIRED' THEN latency_ms ELSE 0 END) AS operator_sum, max(latency_ms) AS slowest FROM spans GROUP BY 1, 2")
def A22_trace_timing(ev: Evidence) -> DataFrame:
    return ev("spans").groupBy("run_id", "trace_id").agg(F.sum(F.when(F.col("status") == "FIRED", F.greatest("latency_ms", F.lit(0.0))).otherwise(0.0)).alias("operator_sum"), F.max("latency_ms").alias("slowest"))


@on("V", "SELECT trace_id, parent_candidate_id AS parent, candidate_id AS child, op_id FROM cands WHERE parent_candidate_id IS NOT NULL")
def W08_lineage_edges(ev: Evidence) -> DataFrame:
    return ev("cands").where("parent_candidate_id is not null").select("trace_id", F.col("parent_candidate_id").alias("parent"), F.col("candidate_id").alias("child"), "op_id")


@on("V", """, b AS (SELECT query_id, candidate_id, min(rank) AS r FROM cands WHERE run_id = 'A' AND op_id = 'select' AND side = 'out' GROUP BY 1, 2), a AS (SELECT query_id, candidate_id, min(rank) AS r FROM cands WHERE run_id = 'B' AND op_id = 'select' AND side = 'out' GROUP BY 1, 2)
SELECT coalesce(b.query_id, a.query_id) AS query_id, coalesce(b.candidate_id, a.candidate_id) AS candidate_id, CASE WHEN b.r IS NULL THEN 'surfaced' WHEN a.r IS NULL THEN 'dropped' WHEN a.r <> b.r THEN 'rank_changed' ELSE 'retained' END AS change
FROM b FULL JOIN a ON a.query_id = b.query_id AND a.candidate_id = b.candidate_id""")  # fmt: skip
def J23_lineage_diff(ev: Evidence) -> DataFrame:
    end = ev("cands").where("op_id = 'select' and side = 'out'")
    side = lambda r, n: end.where(F.col("run_id") == r).groupBy("query_id", "candidate_id").agg(F.min("rank").alias(n))
    j = side("A", "b").join(side("B", "a"), ["query_id", "candidate_id"], "full_outer")
    return j.select("query_id", "candidate_id", F.when(F.col("b").isNull(), "surfaced").when(F.col("a").isNull(), "dropped").when(F.col("a") != F.col("b"), "rank_changed").otherwise("retained").alias("change"))


@on("V", "SELECT trace_id, op_id, doc_id, rank, round(score - lag(score) OVER w, 6) AS step FROM cands WHERE side = 'out' AND run_id = 'A' WINDOW w AS (PARTITION BY trace_id, op_id ORDER BY rank)")
def W06_score_steps(ev: Evidence) -> DataFrame:
    w = Window.partitionBy("trace_id", "op_id").orderBy("rank")
    return ev("cands").where("side = 'out' and run_id = 'A'").select("trace_id", "op_id", "doc_id", "rank", F.round(F.col("score") - F.lag("score").over(w), 6).alias("step"))


@on("V", """, ev AS (SELECT trace_id, doc_id, span_idx, op_id, count(*) FILTER (side = 'in') AS i, count(*) FILTER (side = 'out') AS o FROM cands WHERE doc_id IN (SELECT doc_id FROM qrels WHERE grade = 2) GROUP BY 1, 2, 3, 4)
SELECT trace_id, doc_id, string_agg(op_id || ':' || CASE WHEN o > 0 AND i > 0 THEN 'passed' WHEN o > 0 THEN 'introduced' ELSE 'dropped' END, ' ' ORDER BY span_idx) AS history FROM ev GROUP BY 1, 2""")
def W06_candidate_history(ev: Evidence) -> DataFrame:
    """What became of each document that some query judges best, step by step, in every trace."""
    best = ev("qrels").where("grade = 2").select("doc_id").distinct()
    each = ev("cands").join(best, "doc_id", "left_semi").groupBy("trace_id", "doc_id", "span_idx", "op_id").agg(F.count_if(F.col("side") == "in").alias("i"), F.count_if(F.col("side") == "out").alias("o"))
    kind = F.when((F.col("o") > 0) & (F.col("i") > 0), "passed").when(F.col("o") > 0, "introduced").otherwise("dropped")
    steps = F.array_sort(F.collect_list(F.struct("span_idx", F.concat("op_id", F.lit(":"), kind).alias("s"))))
    return each.groupBy("trace_id", "doc_id").agg(F.array_join(F.transform(steps, lambda x: x["s"]), " ").alias("history"))


@on("V", """SELECT query_id, count(*) FILTER (run_id = 'A') > 0 AS in_a, count(*) FILTER (run_id = 'B' AND query_id <> 'q20') > 0 AS in_b FROM spans GROUP BY 1""")
def J24_query_alignment(ev: Evidence) -> DataFrame:
    s = ev("spans")
    a, b = (s.where(c).select("query_id").distinct() for c in ("run_id = 'A'", "run_id = 'B' and query_id <> 'q20'"))
    j = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "query_id", "full_outer")
    return j.na.fill(False)


@on("V", "SELECT DISTINCT query_id FROM spans WHERE query_id IN (SELECT query_id FROM qrels WHERE grade = 2)")
def J28_expected_queries(ev: Evidence) -> DataFrame:
    return ev("spans").select("query_id").distinct().join(ev("qrels").where("grade = 2"), "query_id", "left_semi")


@on("V", "SELECT trace_id, op_type AS operator_id, arg_max(op_id, span_idx) AS op_id, max(span_idx) AS span_idx FROM spans WHERE status = 'FIRED' GROUP BY 1, 2")
def R43_latest_invocation(ev: Evidence) -> DataFrame:
    fired = ev("spans").where("status = 'FIRED'")
    return fired.groupBy("trace_id", F.col("op_type").alias("operator_id")).agg(F.max_by("op_id", "span_idx").alias("op_id"), F.max("span_idx").alias("span_idx"))


@on("V", "SELECT DISTINCT op_id, op_type, CASE WHEN op_type IN ('FUSE', 'FILTER', 'BOOST') OR (op_type = 'SOURCE' AND op_id = 'dense') THEN 'EXACT' ELSE 'NOT_REPLAYABLE' END AS replay FROM spans")
def R39_replay_tier(ev: Evidence) -> DataFrame:
    s = ev("spans").select("op_id", "op_type", "parents").distinct()
    fused = s.where("op_type = 'FUSE'").select(F.explode(F.split("parents", ",")).alias("op_id")).distinct().withColumn("fused", F.lit(True))
    exact = F.col("op_type").isin("FUSE", "FILTER", "BOOST") | ((F.col("op_type") == "SOURCE") & F.coalesce("fused", F.lit(False)))
    return s.join(fused, "op_id", "left").select("op_id", "op_type", F.when(exact, "EXACT").otherwise("NOT_REPLAYABLE").alias("replay"))


@on("M", "SELECT pipeline_id, round(avg(value) FILTER (run_id = 'cand') - avg(value) FILTER (run_id = 'base'), 6) AS change, avg(value) FILTER (run_id = 'base') - avg(value) FILTER (run_id = 'cand') > 0.005 AS trips FROM metrics GROUP BY 1")
def N07_regression_check(ev: Evidence) -> DataFrame:
    m = ev("metrics").groupBy("pipeline_id").pivot("run_id", ["base", "cand"]).agg(F.avg("value"))
    return m.select("pipeline_id", F.round(F.col("cand") - F.col("base"), 6).alias("change"), N.regression_check(F.col("cand"), F.col("base"), "decrease", 0.005).alias("trips"))


@on("M")
def P02_bootstrap_ci(ev: Evidence) -> DataFrame:
    pairs = C.paired(C.of_run(ev("metrics"), "base"), C.of_run(ev("metrics"), "cand"))
    return C.resampled(pairs, C.KEY).select(*C.KEY, "effect", "low", "high")


@on("V", "SELECT trace_id, query_id, doc_id, rank FROM cands WHERE op_id = 'select' AND side = 'out' AND query_id = 'q0' AND run_id = 'A' ORDER BY rank LIMIT 6")
def I06_one_query(ev: Evidence) -> DataFrame:
    c = store.where_equal(ev("cands"), op_id="select", side="out", query_id="q0", run_id="A", doc_id=None)
    return c.orderBy("rank").limit(6).select("trace_id", "query_id", "doc_id", "rank")


@on("V", "SELECT query_id, op_id, rank FROM cands WHERE doc_id = 'd100' AND side = 'out' AND run_id = 'A'")
def I07_one_document(ev: Evidence) -> DataFrame:
    return store.where_equal(ev("cands"), doc_id="d100", side="out", run_id="A").select("query_id", "op_id", "rank")

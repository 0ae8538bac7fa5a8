"""Queries of retrieval operators and ranking metrics (bindings V and L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.operators import retrieval as R
from evalquarry.operators import scoring as S
from evalquarry.registry import on

KS = [1, 5, 10]


def _lists(ev: Evidence, op: str, run: str = "A") -> DataFrame:
    return ev("cands").where((F.col("op_id") == op) & (F.col("side") == "out") & (F.col("run_id") == run)).select("query_id", "doc_id", "score", "rank")


def _vectors(ev: Evidence) -> tuple[DataFrame, DataFrame]:
    e = ev("embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("doc_id"), "embedding")


@on("V", "SELECT qid AS query_id, did AS doc_id, round(score, 6) AS score, rank FROM v_dense")
def R03_dense_top_k(ev: Evidence) -> DataFrame:
    return R.dense(*_vectors(ev), top_k=50)


@on("V", "SELECT qid AS query_id, did AS doc_id, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS rank FROM v_sim WHERE label = 3 QUALIFY rank <= 5")
def S26_filtered_vector_search(ev: Evidence) -> DataFrame:
    return R.dense(*_vectors(ev), top_k=5, allow=ev("embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id")))


@on("V", "SELECT qid AS query_id, did AS doc_id, s AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS rank FROM v_sim QUALIFY rank <= 3", name="R01_source_k_override")
def _source(ev: Evidence) -> DataFrame:
    return R.dense(*_vectors(ev), top_k=3)


_BM25 = """, dl AS (SELECT doc_id, count(*) AS dl FROM l_tok GROUP BY 1), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT t.w, t.doc_id, count(*) AS tf FROM l_tok t WHERE t.w IN (SELECT w FROM l_qtok) GROUP BY 1, 2), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT q.item_id AS query_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM l_qtok q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN dl ON dl.doc_id = tf.doc_id, tot GROUP BY 1, 2)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""


@on("L", _BM25)
def R02_bm25(ev: Evidence) -> DataFrame:
    words = ev("l_q").select(F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), r"[ \t\n\r]+")).alias("w"))
    return R.bm25_texts(words.where("w <> ''"), ev("documents").select("doc_id", F.lower("text").alias("text")), top_k=10)


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, score, rank FROM v_fuse WHERE run_id = 'A'")
def R04_fuse_rrf(ev: Evidence) -> DataFrame:
    return R.fuse([_lists(ev, "dense"), _lists(ev, "filter")], top_k=30)


@on("V", """, a AS (SELECT 0 AS arm, qid, did, rank FROM v_dense UNION ALL SELECT 1, qid, did, rank FROM v_lex)
SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, arm, r) AS rank
FROM (SELECT qid, did, round(sum(1e0 / (60 + rank)), 9) AS score, min(arm) AS arm, arg_min(rank, arm) AS r FROM a GROUP BY 1, 2) QUALIFY rank <= 20""")  # fmt: skip
def R05_rrf_first_seen(ev: Evidence) -> DataFrame:
    return R.fuse([_lists(ev, "dense"), _lists(ev, "lexical")], top_k=20, ties="first_seen")


@on("V", "SELECT * FROM (SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, -score AS score, row_number() OVER (PARTITION BY qid ORDER BY -score DESC, rank) AS rank FROM v_dense) WHERE rank <= 10")
def R06_rerank(ev: Evidence) -> DataFrame:
    return R.rerank(_lists(ev, "dense"), -F.col("score"), top_k=10)


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, score, rank FROM v_filter WHERE run_id = 'A'")
def R09_filter(ev: Evidence) -> DataFrame:
    return R.keep(_lists(ev, "lexical"), F.substring("doc_id", 2, 20).cast("long") % 5 != 0)


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, rank, 'filtered' AS drop_reason FROM v_lex WHERE did % 5 = 0")
def R09_filter_drops(ev: Evidence) -> DataFrame:
    return R.drops(_lists(ev, "lexical"), _lists(ev, "filter"), "filtered").select("query_id", "doc_id", "rank", "drop_reason")


@on("V", "SELECT concat('q', qid) AS query_id, CASE WHEN qid % 40 = 0 THEN 'rerank' ELSE 'fast' END AS route, count(*) AS n FROM v_fuse WHERE run_id = 'A' GROUP BY 1, 2")
def R10_gate(ev: Evidence) -> DataFrame:
    route = F.when(F.substring("query_id", 2, 20).cast("long") % 40 == 0, "rerank").otherwise("fast")
    return R.gate(_lists(ev, "fuse"), route, ["rerank", "fast"]).groupBy("query_id", "route").agg(F.count("*").alias("n"))


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, round(score + CASE WHEN did % 3 = 0 THEN 0.5 ELSE 0 END, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score + CASE WHEN did % 3 = 0 THEN 0.5 ELSE 0 END, 6) DESC, rank) AS rank FROM v_dense")
def R11_boost(ev: Evidence) -> DataFrame:
    return R.boost(_lists(ev, "dense"), F.round(F.col("score") + F.when(F.substring("doc_id", 2, 20).cast("long") % 3 == 0, 0.5).otherwise(0.0), 6))


@on("V", """, b AS (SELECT qid, did, score, rank FROM v_dense WHERE rank <= 5), n AS (SELECT qid, did + 1 AS did, max(score) AS score FROM b GROUP BY 1, 2)
SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY g, k, score DESC, concat('d', did)) AS rank FROM (
  SELECT qid, did, score, 0 AS g, rank AS k FROM b UNION ALL SELECT qid, did, score * 0.9, 1, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.qid = n.qid AND b.did = n.did))""")  # fmt: skip
def R12_expand(ev: Evidence) -> DataFrame:
    e = ev("embeddings").select(F.concat(F.lit("d"), "vec_id").alias("src"), F.concat(F.lit("d"), F.col("vec_id") + 1).alias("dst"))
    # nine tenths of six digits often end in a half: rounded as a product of doubles, not as a decimal
    six = F.floor(F.col("score") * 1e6 + 0.5) / 1e6
    return R.expand(_lists(ev, "dense").where("rank <= 5"), e).select("query_id", "doc_id", six.alias("score"), "rank")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, rank, CASE WHEN rank > 10 THEN 'truncated' END AS drop_reason FROM v_dense")
def W17_truncation(ev: Evidence) -> DataFrame:
    return R.truncate(_lists(ev, "dense"), 10).select("query_id", "doc_id", "rank", "drop_reason")


@on("V", "SELECT concat('q', qid) AS query_id, concat('d', did) AS candidate_id, min(rank) AS rank, count(*) - 1 AS dropped_duplicates FROM (SELECT qid, did, rank FROM v_dense UNION ALL SELECT qid, did, rank FROM v_lex) GROUP BY 1, 2")
def R18_output_dedupe(ev: Evidence) -> DataFrame:
    both = _lists(ev, "dense").union(_lists(ev, "lexical")).withColumnRenamed("doc_id", "candidate_id")
    return R.dedupe(both, "query_id").select("query_id", "candidate_id", "rank", "dropped_duplicates")


@on("V", """SELECT trace_id, span_idx, candidate_id, min(CASE WHEN side = 'in' THEN rank END) AS input_rank, min(CASE WHEN side = 'out' THEN rank END) AS output_rank,
  count(CASE WHEN side = 'in' THEN 1 END) AS occurrences, coalesce(string_agg(DISTINCT parent_op_id, ',' ORDER BY parent_op_id), '') AS origins,
  CASE WHEN count(CASE WHEN side = 'in' THEN 1 END) = 0 THEN 'added' WHEN count(CASE WHEN side = 'out' THEN 1 END) = 0 THEN 'dropped' ELSE 'kept' END AS change
FROM cands GROUP BY ALL""")  # fmt: skip
def R19_candidate_transition(ev: Evidence) -> DataFrame:
    c = ev("cands")
    keys = ["trace_id", "span_idx"]
    t = R.transition(c.where("side = 'in'"), c.where("side = 'out'"), keys)
    return t.select(*keys, "candidate_id", "input_rank", "output_rank", F.coalesce("input_occurrences", F.lit(0)).alias("occurrences"), F.coalesce("origins", F.lit("")).alias("origins"), "change")


@on("L", "SELECT i.item_id AS doc_id, CASE WHEN i.item_id % 2 = 0 THEN i.text ELSE coalesce(d.text, '') END AS text FROM benchmark i LEFT JOIN documents d ON d.doc_id = i.item_id")
def R28_text_hydration(ev: Evidence) -> DataFrame:
    c = ev("benchmark").select(F.col("item_id").alias("doc_id"), F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("").alias("text"))
    return R.hydrate(c, ev("documents"))


_WIDE = """, rel AS (SELECT query_id, doc_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qrels WHERE grade > 0),
ideal AS (SELECT query_id, count(*) AS n_rel, sum(1 / log2(i + 1)) FILTER (i <= 10) AS ib, sum(grade / log2(i + 1)) FILTER (i <= 10) AS ig FROM rel GROUP BY 1),
hit AS (SELECT c.run_id, c.op_id, c.query_id, c.rank, r.grade, row_number() OVER (PARTITION BY c.run_id, c.op_id, c.query_id ORDER BY c.rank) AS h
  FROM cands c JOIN rel r ON r.query_id = c.query_id AND r.doc_id = c.doc_id WHERE c.side = 'out'),
agg AS (SELECT run_id, op_id, query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(grade / log2(rank + 1)) FILTER (rank <= 10) AS dcgg,
  min(rank) AS first, sum(h * 1e0 / rank) AS ap FROM hit GROUP BY 1, 2, 3),
wide AS (SELECT s.run_id, s.op_id, s.query_id, n_rel, coalesce(h5, 0) * 1e0 / n_rel AS recall_5, coalesce(h10, 0) * 1e0 / n_rel AS recall_10, coalesce(h10, 0) / 10e0 AS precision_10,
  coalesce(dcg, 0) / ib AS ndcg_10, coalesce(dcgg, 0) / ig AS ndcg_graded_10, coalesce(1e0 / first, 0) AS mrr, coalesce(ap, 0) / n_rel AS ap
  FROM spans s JOIN ideal USING (query_id) LEFT JOIN agg a ON a.run_id = s.run_id AND a.op_id = s.op_id AND a.query_id = s.query_id WHERE s.status = 'FIRED')"""


def wide(ev: Evidence, ks: list[int] = [5, 10]) -> DataFrame:  # noqa: B006
    lists = ev("cands").where("side = 'out'")
    return S.measures(lists, ev("qrels"), ks, ["run_id", "op_id"], spans=ev("spans").where("status = 'FIRED'"))


def _metric(name: str, column: str) -> None:
    @on("V", f"{_WIDE} SELECT run_id, op_id, query_id, round({column}, 6) AS value FROM wide", name=name)
    def query(ev: Evidence) -> DataFrame:
        return wide(ev).select("run_id", "op_id", "query_id", F.round(column, 6).alias("value"))


for _name, _column in {
    "F01_recall_at_k": "recall_10", "F05_mrr": "mrr", "F06_ndcg_binary": "ndcg_10", "F07_precision_at_k": "precision_10", "F08_average_precision": "ap", "F10_ndcg_graded": "ndcg_graded_10",
}.items():
    _metric(_name, _column)


@on("V", f"{_WIDE} SELECT run_id, op_id, round(avg(ap), 6) AS map FROM wide GROUP BY 1, 2")
def F09_map(ev: Evidence) -> DataFrame:
    return wide(ev).groupBy("run_id", "op_id").agg(F.round(F.avg("ap"), 6).alias("map"))


_LONG = f"""{_WIDE}, long AS (SELECT run_id, op_id, query_id, 'recall' AS metric_name, 10 AS k, recall_10 AS value FROM wide UNION ALL SELECT run_id, op_id, query_id, 'precision', 10, precision_10 FROM wide
  UNION ALL SELECT run_id, op_id, query_id, 'ndcg', 10, ndcg_graded_10 FROM wide UNION ALL SELECT run_id, op_id, query_id, 'mrr', 0, mrr FROM wide UNION ALL SELECT run_id, op_id, query_id, 'map', 0, ap FROM wide)"""


def long(ev: Evidence) -> DataFrame:
    return S.quality_rows(wide(ev, [10]), [10], ["run_id", "op_id"])


@on("V", f"""{_LONG}, lat AS (SELECT run_id, 'end' AS op_id, query_id, 'latency_ms' AS metric_name, 0 AS k, sum(latency_ms) AS value FROM spans WHERE status = 'FIRED' GROUP BY 1, 3)
SELECT run_id, op_id, query_id, metric_name, k, round(value, 6) AS value FROM long UNION ALL SELECT run_id, 'end', query_id, metric_name, k, round(value, 6) FROM long WHERE op_id = 'select' UNION ALL SELECT * FROM lat""")  # fmt: skip
def A01_metric_fan_out(ev: Evidence) -> DataFrame:
    rows = long(ev).select("run_id", "op_id", "query_id", "metric_name", "k", F.round("value", 6).alias("value"))
    end = rows.where("op_id = 'select'").withColumn("op_id", F.lit("end"))
    spans = ev("spans").where("status = 'FIRED'")
    latency = spans.groupBy("run_id", F.lit("end").alias("op_id"), "query_id").agg(F.sum("latency_ms").alias("value"))
    return rows.unionByName(end).unionByName(latency.withColumns({"metric_name": F.lit("latency_ms"), "k": F.lit(0)}))


@on("V", f"{_LONG} SELECT run_id, op_id, query_id, metric_name, k, round(value, 6) AS value FROM long WHERE run_id = 'B'")
def A03_quality_rows(ev: Evidence) -> DataFrame:
    return long(ev).where("run_id = 'B'").select("run_id", "op_id", "query_id", "metric_name", "k", F.round("value", 6).alias("value"))


@on("V", f"""{_LONG} SELECT run_id, op_id, metric_name, k, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n,
  count(*) FILTER (value = 0) AS zero_count, round(100e0 * count(*) FILTER (value = 0) / count(*), 1) AS zero_pct FROM long GROUP BY 1, 2, 3, 4""")  # fmt: skip
def A05_grouped_aggregate(ev: Evidence) -> DataFrame:
    a = S.aggregate(long(ev), ["run_id", "op_id", "metric_name", "k"])
    return a.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@on("V", f"{_WIDE} SELECT run_id, op_id, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS map, count(*) AS n FROM wide GROUP BY 1, 2")
def stage_quality(ev: Evidence) -> DataFrame:
    """The flagship: mean quality of every operator of every run."""
    r = lambda c: F.round(F.avg(c), 6)
    return wide(ev).groupBy("run_id", "op_id").agg(r("recall_10").alias("recall_10"), r("ndcg_10").alias("ndcg_10"), r("mrr").alias("mrr"), r("ap").alias("map"), F.count("*").alias("n"))


@on("V", """, rel AS (SELECT q.query_id, q.doc_id, abs(CAST(substr(q.query_id, 2) AS BIGINT) - CAST(substr(q.doc_id, 2) AS BIGINT)) AS distance FROM qrels q WHERE grade > 0),
w AS (SELECT rel.query_id, exp(-1e0 * CASE WHEN distance % 13 = 0 THEN 0 ELSE distance END / 100e0) AS w, d.rank FROM rel LEFT JOIN (SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, rank FROM v_dense) d
  ON d.query_id = rel.query_id AND d.doc_id = rel.doc_id AND d.rank <= 10) SELECT query_id, round(coalesce(sum(w) FILTER (rank IS NOT NULL), 0) / sum(w), 6) AS temporal_recall FROM w GROUP BY 1""")  # fmt: skip
def F02_temporal_recall(ev: Evidence) -> DataFrame:
    number = lambda c: F.substring(c, 2, 20).cast("long")
    rel = ev("qrels").where("grade > 0").withColumn("distance", F.abs(number("query_id") - number("doc_id")))
    rel = rel.withColumn("distance", F.when(F.col("distance") % 13 != 0, F.col("distance")))
    out = S.temporal_recall(_lists(ev, "dense"), rel, 10, 100.0)
    return out.select("query_id", F.round("temporal_recall", 6).alias("temporal_recall"))


def _linear(ev: Evidence, kind: str) -> DataFrame:
    number = lambda c: F.substring(c, 2, 20).cast("long")
    rel = ev("qrels").where("grade > 0").withColumn("distance", F.abs(number("query_id") - number("doc_id")))
    return S.temporal_recall(_lists(ev, "dense"), rel, 10, 250.0, kind).select("query_id", F.round("temporal_recall", 6).alias("temporal_recall"))


_DECAY = """, rel AS (SELECT q.query_id, q.doc_id, abs(CAST(substr(q.query_id, 2) AS BIGINT) - CAST(substr(q.doc_id, 2) AS BIGINT)) / 250e0 AS x FROM qrels q WHERE grade > 0),
w AS (SELECT rel.query_id, {w} AS w, d.rank FROM rel LEFT JOIN (SELECT concat('q', qid) AS query_id, concat('d', did) AS doc_id, rank FROM v_dense) d ON d.query_id = rel.query_id AND d.doc_id = rel.doc_id AND d.rank <= 10)
SELECT query_id, round(coalesce(coalesce(sum(w) FILTER (rank IS NOT NULL), 0) / nullif(sum(w), 0), 0), 6) AS temporal_recall FROM w GROUP BY 1"""
on("V", _DECAY.format(w="greatest(0e0, 1 - x)"), name="F02_temporal_recall_linear")(lambda ev: _linear(ev, "linear"))
on("V", _DECAY.format(w="CASE WHEN x <= 1 THEN 1e0 ELSE 0e0 END"), name="F03_temporal_recall_step")(lambda ev: _linear(ev, "step"))


@on("V", """, j AS (SELECT op_id, query_id, doc_id, min(rank) AS k FROM cands WHERE side = 'in' AND run_id = 'A' GROUP BY 1, 2, 3)
SELECT op_id, query_id, doc_id, row_number() OVER (PARTITION BY op_id, query_id ORDER BY k, doc_id) AS rank FROM j""")  # fmt: skip
def F04_rank_dedupe(ev: Evidence) -> DataFrame:
    return S.deduped(ev("cands").where("side = 'in' and run_id = 'A'"), "op_id")


@on("V", "SELECT op_id, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, count(*) AS n FROM spans WHERE status = 'FIRED' GROUP BY 1")
def F12_stage_percentiles(ev: Evidence) -> DataFrame:
    p = S.percentiles(ev("spans").where("status = 'FIRED'"), ["op_id"], "latency_ms")
    return p.select("op_id", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "n")


_CHURN = """, st AS (SELECT run_id, query_id, span_idx, doc_id FROM cands WHERE side = 'out' AND op_id IN ('lexical', 'filter', 'fuse')),
p AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.span_idx, b.span_idx + 1) AS span_idx, a.doc_id AS now, b.doc_id AS before
  FROM st a FULL JOIN st b ON a.run_id = b.run_id AND a.query_id = b.query_id AND a.span_idx = b.span_idx + 1 AND a.doc_id = b.doc_id),
churn AS (SELECT run_id, query_id, span_idx, count(*) FILTER (before IS NULL) AS entered, count(*) FILTER (now IS NOT NULL AND before IS NOT NULL) AS survived, count(*) FILTER (now IS NULL) AS dropped
  FROM p WHERE span_idx BETWEEN 2 AND 3 GROUP BY 1, 2, 3)"""


def churn(ev: Evidence) -> DataFrame:
    """Between consecutive stages: how many entered, survived and dropped."""
    st = ev("cands").where("side = 'out' and op_id in ('lexical', 'filter', 'fuse')").select("run_id", "query_id", "span_idx", "doc_id")
    on_ = ["run_id", "query_id", "span_idx", "doc_id"]
    j = st.withColumn("now", F.lit(1)).join(st.withColumn("span_idx", F.col("span_idx") + 1).withColumn("before", F.lit(1)), on_, "full_outer").where("span_idx between 2 and 3")
    a, b = F.col("now").isNotNull(), F.col("before").isNotNull()
    return j.groupBy("run_id", "query_id", "span_idx").agg(F.count_if(~b).alias("entered"), F.count_if(a & b).alias("survived"), F.count_if(~a).alias("dropped"))


@on("V", f"{_CHURN} SELECT * FROM churn")
def F13_stage_churn(ev: Evidence) -> DataFrame:
    return churn(ev)


@on("V", f"{_CHURN} SELECT run_id, round(coalesce(avg(dropped * 1e0 / (survived + dropped)) FILTER (entered = 0 OR survived + entered <= survived + dropped), 0), 6) AS churn_rate FROM churn GROUP BY 1")
def F14_mean_churn(ev: Evidence) -> DataFrame:
    rate = F.col("dropped") / (F.col("survived") + F.col("dropped"))
    return churn(ev).groupBy("run_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("entered") <= F.col("dropped"), rate)), F.lit(0.0)), 6).alias("churn_rate"))

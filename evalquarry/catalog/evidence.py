"""Queries of journeys, diagnostics and analyses (bindings V and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalquarry.bindings import Evidence
from evalquarry.operators import analysis as N
from evalquarry.operators import diagnostics as D
from evalquarry.operators import journeys as J
from evalquarry.registry import on

K = 5

_EVENTS = """, fired AS (SELECT run_id, trace_id, query_id, span_idx, op_id, output_capture = 'recorded' AS complete FROM spans WHERE status = 'FIRED'),
i AS (SELECT trace_id, span_idx, candidate_id, min(rank) AS input_rank, count(*) AS n_in, max(reason) AS decision FROM cands WHERE side = 'in' GROUP BY 1, 2, 3),
o AS (SELECT trace_id, span_idx, candidate_id, min(rank) AS output_rank FROM cands WHERE side = 'out' GROUP BY 1, 2, 3),
ch AS (SELECT trace_id, span_idx, parent_candidate_id AS candidate_id, min(rank) AS child_rank FROM cands WHERE side = 'out' AND parent_candidate_id IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT f.*, b.candidate_id, b.input_rank, b.n_in, b.decision, b.output_rank, ch.child_rank, b.output_rank IS NULL AND ch.child_rank IS NULL AND f.complete AS gone
  FROM (SELECT coalesce(i.trace_id, o.trace_id) AS trace_id, coalesce(i.span_idx, o.span_idx) AS span_idx, coalesce(i.candidate_id, o.candidate_id) AS candidate_id, input_rank, n_in, decision, output_rank
    FROM i FULL JOIN o ON i.trace_id = o.trace_id AND i.span_idx = o.span_idx AND i.candidate_id = o.candidate_id) b
  JOIN fired f ON f.trace_id = b.trace_id AND f.span_idx = b.span_idx LEFT JOIN ch ON ch.trace_id = b.trace_id AND ch.span_idx = b.span_idx AND ch.candidate_id = b.candidate_id),
y AS (SELECT *, coalesce(bool_or(gone) OVER (PARTITION BY trace_id, candidate_id ORDER BY span_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM x),
ev AS (SELECT *, candidate_id AS doc_id, CASE WHEN output_rank IS NOT NULL AND input_rank IS NULL THEN CASE WHEN before THEN 'recovered' ELSE 'introduced' END
  WHEN output_rank IS NOT NULL THEN CASE WHEN output_rank = input_rank THEN 'retained' WHEN output_rank < input_rank THEN 'promoted' ELSE 'demoted' END
  WHEN child_rank IS NOT NULL THEN 'transformed' WHEN NOT complete THEN 'unknown' ELSE 'removed' END AS kind FROM y)"""
_ROWS = f"""{_EVENTS}, fin AS (SELECT trace_id, doc_id, min(output_rank) AS final_rank FROM ev WHERE op_id = 'select' AND output_rank IS NOT NULL GROUP BY 1, 2),
loss AS (SELECT trace_id, doc_id, arg_max(CASE WHEN kind = 'removed' THEN op_id ELSE 'unknown' END, span_idx) AS at_op FROM ev WHERE kind IN ('removed', 'unknown') GROUP BY 1, 2),
seen AS (SELECT trace_id, doc_id, count(*) AS n_events, bool_or(NOT complete) AS part FROM ev GROUP BY 1, 2), tr AS (SELECT DISTINCT run_id, trace_id, query_id FROM spans),
need AS (SELECT tr.trace_id, q.doc_id FROM tr JOIN qrels q USING (query_id) WHERE grade >= 1),
al AS (SELECT coalesce(s.trace_id, n.trace_id) AS trace_id, coalesce(s.doc_id, n.doc_id) AS doc_id, n_events, part FROM seen s FULL JOIN need n ON s.trace_id = n.trace_id AND s.doc_id = n.doc_id),
jr AS (SELECT tr.run_id, al.trace_id, tr.query_id, al.doc_id, q.grade, CASE WHEN q.grade IS NULL THEN 'unknown' WHEN q.grade >= 1 THEN 'relevant' ELSE 'nonrelevant' END AS judgment, n_events IS NOT NULL AS observed, final_rank,
  CASE WHEN final_rank <= {K} THEN 'included' ELSE 'excluded' END AS membership, coalesce(n_events, 0) AS n_events, coalesce(part, false) AS partial,
  CASE WHEN final_rank <= {K} THEN NULL WHEN final_rank IS NOT NULL THEN 'select' WHEN n_events IS NULL THEN 'not_observed' ELSE at_op END AS loss_boundary
  FROM al JOIN tr ON tr.trace_id = al.trace_id LEFT JOIN qrels q ON q.query_id = tr.query_id AND q.doc_id = al.doc_id LEFT JOIN fin ON fin.trace_id = al.trace_id AND fin.doc_id = al.doc_id
  LEFT JOIN loss ON loss.trace_id = al.trace_id AND loss.doc_id = al.doc_id),
jo AS (SELECT *, CASE WHEN judgment = 'nonrelevant' THEN 'judged_nonrelevant' WHEN judgment = 'unknown' THEN 'unjudged' WHEN membership = 'included' THEN 'relevant_delivered'
  WHEN final_rank IS NOT NULL THEN 'retained_below_cutoff' WHEN loss_boundary = 'unknown' THEN 'insufficient_evidence' WHEN NOT observed THEN 'not_observed' ELSE 'relevant_excluded' END AS outcome,
  CASE WHEN judgment = 'unknown' THEN 'unknown' WHEN judgment = 'relevant' THEN CASE WHEN membership = 'included' THEN 'TP' ELSE 'FN' END WHEN membership = 'included' THEN 'FP' ELSE 'TN' END AS confusion FROM jr)"""


def _events(ev: Evidence) -> DataFrame:
    return J.events(ev("cands"), ev("spans"))


def _rows(ev: Evidence) -> DataFrame:
    return J.journeys(ev("cands"), ev("spans"), ev("qrels"), K)


@on("V", f"""{_EVENTS} SELECT trace_id, op_id, candidate_id, kind, input_rank, coalesce(output_rank, child_rank) AS output_rank, coalesce(n_in, 0) AS input_occurrences,
  CASE WHEN kind = 'removed' THEN decision WHEN input_rank IS NOT NULL AND output_rank IS NOT NULL AND n_in > 1 THEN 'deduplicated' END AS reason FROM ev""")  # fmt: skip
def W01_journey_events(ev: Evidence) -> DataFrame:
    return _events(ev).select("trace_id", "op_id", "candidate_id", "kind", "input_rank", "output_rank", "input_occurrences", "reason")


@on("V", f"""{_ROWS} SELECT trace_id, doc_id, judgment, observed, final_rank, membership, loss_boundary, partial, outcome, confusion, n_events, CASE outcome WHEN 'relevant_excluded' THEN CASE WHEN partial THEN 1 ELSE 0 END
  WHEN 'not_observed' THEN 0 WHEN 'insufficient_evidence' THEN 1 WHEN 'relevant_delivered' THEN 2 WHEN 'retained_below_cutoff' THEN 3 WHEN 'judged_nonrelevant' THEN 4 ELSE 5 END AS priority FROM jo""")  # fmt: skip
def W02_journey_rows(ev: Evidence) -> DataFrame:
    return _rows(ev).select("trace_id", "doc_id", "judgment", "observed", "final_rank", "membership", "loss_boundary", "partial", "outcome", "confusion", "n_events", "priority")


@on("V", "SELECT DISTINCT run_id, op_id FROM spans WHERE is_final")
def W03_final_operators(ev: Evidence) -> DataFrame:
    return J.finals(ev("spans"))


@on("V", "SELECT DISTINCT run_id, op_id FROM spans WHERE op_id NOT IN (SELECT unnest(string_split(parents, ',')) FROM spans)")
def W04_final_fallback(ev: Evidence) -> DataFrame:
    return J.finals(ev("spans").withColumn("is_final", F.lit(False)))


@on("V", """, RECURSIVE_E AS (SELECT DISTINCT run_id, op_id, unnest(string_split(parents, ',')) AS parent FROM spans), r1 AS (SELECT DISTINCT run_id, op_id FROM spans WHERE op_id = 'fuse'),
r2 AS (SELECT run_id, parent AS op_id FROM r1 JOIN RECURSIVE_E USING (run_id, op_id)), r3 AS (SELECT run_id, parent AS op_id FROM r2 JOIN RECURSIVE_E USING (run_id, op_id) WHERE parent <> '')
SELECT * FROM r1 UNION SELECT * FROM r2 UNION SELECT * FROM r3""")  # fmt: skip
def W05_ancestors(ev: Evidence) -> DataFrame:
    return J.ancestors(ev("spans").withColumn("is_final", F.col("op_id") == "fuse"))


@on("V", f"""{_ROWS} SELECT run_id, outcome, confusion, count(*) AS pairs, sum(n_events) AS events FROM jo GROUP BY 1, 2, 3""")
def A32_confusion_counts(ev: Evidence) -> DataFrame:
    return _rows(ev).groupBy("run_id", "outcome", "confusion").agg(F.count("*").alias("pairs"), F.sum("n_events").alias("events"))


@on("V", f"""{_ROWS} SELECT run_id, count(*) AS pairs, sum(n_events) AS events, count(*) FILTER (outcome = 'relevant_delivered') AS relevant_delivered, count(*) FILTER (outcome = 'relevant_excluded') AS relevant_excluded,
  count(*) FILTER (outcome = 'retained_below_cutoff') AS retained_below_cutoff, count(*) FILTER (outcome = 'not_observed') AS not_observed, count(*) FILTER (outcome = 'insufficient_evidence') AS insufficient_evidence,
  count(*) FILTER (outcome = 'judged_nonrelevant') AS judged_nonrelevant, count(*) FILTER (outcome = 'unjudged') AS unjudged, count(*) FILTER (confusion = 'TP') AS cell_tp, count(*) FILTER (confusion = 'FP') AS cell_fp,
  count(*) FILTER (confusion = 'FN') AS cell_fn, count(*) FILTER (confusion = 'TN') AS cell_tn, count(*) FILTER (confusion = 'unknown') AS cell_unknown,
  count(*) FILTER (judgment = 'relevant' AND membership = 'excluded' AND observed) AS misses_observed, count(*) FILTER (judgment = 'relevant' AND NOT observed) AS misses_never_observed FROM jo GROUP BY 1""")  # fmt: skip
def A23_pair_summary(ev: Evidence) -> DataFrame:
    return J.pair_counts(_rows(ev), "run_id")


@on("V", f"""{_ROWS} SELECT run_id, query_id, doc_id, count(*) AS pairs, count(*) FILTER (outcome = 'relevant_delivered') AS delivered, count(*) FILTER (membership = 'excluded') AS excluded,
  count(*) FILTER (outcome = 'not_observed') AS not_observed, count(*) FILTER (outcome = 'insufficient_evidence') AS unknown FROM jo GROUP BY GROUPING SETS ((run_id), (run_id, query_id), (run_id, doc_id))""")  # fmt: skip
def A24_journey_summary(ev: Evidence) -> DataFrame:
    return J.journey_summary(_rows(ev))


@on("V", f"""{_EVENTS}, s AS (SELECT run_id, op_id, count(*) FILTER (status = 'FIRED') AS queries_served, count(*) FILTER (status = 'SKIPPED_BY_GATE') AS queries_skipped,
  count(*) FILTER (status = 'FIRED' AND output_capture <> 'recorded') AS partial_boundaries FROM spans GROUP BY 1, 2)
SELECT s.*, coalesce(g.n, 0) AS candidates_received, coalesce(e.i, 0) AS introduced, coalesce(e.r, 0) AS removal_events FROM s
LEFT JOIN (SELECT run_id, op_id, count(*) AS n FROM cands WHERE side = 'in' GROUP BY 1, 2) g ON g.run_id = s.run_id AND g.op_id = s.op_id
LEFT JOIN (SELECT run_id, op_id, count(*) FILTER (kind IN ('introduced', 'recovered')) AS i, count(*) FILTER (kind = 'removed') AS r FROM ev GROUP BY 1, 2) e ON e.run_id = s.run_id AND e.op_id = s.op_id""")  # fmt: skip
def A25_stage_summary(ev: Evidence) -> DataFrame:
    return J.stage_summary(ev("cands"), ev("spans"))


_AT = f"""{_ROWS}, rel AS (SELECT ev.run_id, ev.trace_id, ev.doc_id, ev.op_id, jo.outcome, jo.loss_boundary, bool_or(input_rank IS NOT NULL) AS i, bool_or(output_rank IS NOT NULL OR child_rank IS NOT NULL) AS o,
  bool_or(coalesce(output_rank, child_rank) <= {K}) AS t, bool_or(kind = 'removed') AS r FROM ev JOIN jo ON jo.trace_id = ev.trace_id AND jo.doc_id = ev.doc_id WHERE judgment = 'relevant' GROUP BY ALL),
p AS (SELECT *, outcome = 'retained_below_cutoff' AND bool_or(coalesce(t, false) AND op_id <> coalesce(loss_boundary, '')) OVER (PARTITION BY trace_id, doc_id) AS pushed FROM rel)"""


@on("V", f"""{_AT} SELECT run_id, op_id, count(*) AS seen, count(*) FILTER (i) AS input, count(*) FILTER (o) AS output, count(*) FILTER (t) AS in_top_k, count(*) FILTER (r) AS removed,
  count(*) FILTER (r AND outcome = 'relevant_delivered') AS removed_but_delivered, count(*) FILTER (loss_boundary = op_id AND outcome = 'relevant_excluded' AND NOT pushed) AS dropped,
  count(*) FILTER (loss_boundary = op_id AND outcome = 'retained_below_cutoff' AND NOT pushed) AS ranked_low, count(*) FILTER (loss_boundary = op_id AND pushed) AS pushed_out,
  count(*) FILTER (loss_boundary = op_id AND outcome = 'insufficient_evidence' AND NOT pushed) AS lost_unknown FROM p GROUP BY 1, 2""")  # fmt: skip
def A26_flow(ev: Evidence) -> DataFrame:
    return J.flow(ev("cands"), ev("spans"), _rows(ev), K)


@on("V", f"""{_AT} SELECT a.run_id, a.op_id AS from_op, b.op_id AS to_op, count(*) AS pairs FROM p a JOIN p b ON a.trace_id = b.trace_id AND a.doc_id = b.doc_id AND a.op_id <> b.op_id WHERE a.o AND b.i GROUP BY 1, 2, 3""")
def A26_copresence(ev: Evidence) -> DataFrame:
    return J.copresence(ev("cands"), ev("spans"), _rows(ev))


@on("V", f"""{_ROWS}, up AS (SELECT trace_id, doc_id, bool_or(rank <= {K}) AS w FROM cands WHERE side = 'out' GROUP BY 1, 2)
SELECT run_id, CASE WHEN outcome = 'relevant_delivered' THEN 'delivered' WHEN w THEN 'destroyed' WHEN w IS NOT NULL THEN 'never_in_window' ELSE 'never_surfaced' END AS loss_class, count(*) AS pairs
FROM jo LEFT JOIN up USING (trace_id, doc_id) WHERE judgment = 'relevant' GROUP BY 1, 2""")  # fmt: skip
def A43_loss_classes(ev: Evidence) -> DataFrame:
    return J.loss_classes(ev("cands"), _rows(ev), K).groupBy("run_id", "loss_class").agg(F.count("*").alias("pairs"))


_DIFF = f"""{_ROWS}, b AS (SELECT * FROM jo WHERE run_id = 'A'), a AS (SELECT * FROM jo WHERE run_id = 'B'),
df AS (SELECT coalesce(b.query_id, a.query_id) AS query_id, coalesce(b.doc_id, a.doc_id) AS doc_id, b.final_rank AS before_rank, a.final_rank AS after_rank,
  CASE WHEN b.doc_id IS NULL THEN 'missing_in_baseline' WHEN a.doc_id IS NULL THEN 'missing_in_candidate' ELSE 'aligned' END AS alignment, coalesce(b.partial, false) OR coalesce(a.partial, false) AS capture_limited,
  CASE WHEN coalesce(b.membership, 'excluded') <> coalesce(a.membership, 'excluded') THEN CASE WHEN b.membership = 'included' THEN 'lost' ELSE 'gained' END
    WHEN b.membership = 'included' THEN CASE WHEN b.final_rank <> a.final_rank THEN 'rank_changed' ELSE 'unchanged' END
    WHEN (CASE WHEN b.doc_id IS NULL THEN 'not_observed' ELSE coalesce(b.loss_boundary, '') END) <> (CASE WHEN a.doc_id IS NULL THEN 'not_observed' ELSE coalesce(a.loss_boundary, '') END) OR coalesce(b.partial, false) <> coalesce(a.partial, false) THEN 'path_changed'
    ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.query_id = b.query_id AND a.doc_id = b.doc_id)"""


def _diff(ev: Evidence) -> DataFrame:
    rows = _rows(ev)
    return J.journey_diff(rows.where("run_id = 'A'"), rows.where("run_id = 'B'"))


@on("V", f"{_DIFF} SELECT * FROM df")
def J21_journey_diff(ev: Evidence) -> DataFrame:
    return _diff(ev)


@on("V", f"{_DIFF} SELECT c.change, count(df.change) AS n, count(*) FILTER (df.capture_limited) AS limited FROM (VALUES {', '.join(f'({chr(39)}{c}{chr(39)})' for c in J.CHANGES)}) c(change) LEFT JOIN df ON df.change = c.change GROUP BY 1")
def A41_diff_summary(ev: Evidence) -> DataFrame:
    return J.diff_summary(_diff(ev))


@on("V", """, s AS (SELECT run_id, op_type AS operator_id, op_id, span_idx AS idx FROM spans WHERE query_id = 'q0' AND (run_id = 'A' OR op_id <> 'fast')),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, operator_id ORDER BY idx) AS nth FROM s)
SELECT coalesce(b.operator_id, a.operator_id) AS operator_id, coalesce(b.nth, a.nth) AS nth, b.op_id AS before_op, a.op_id AS after_op, CASE WHEN b.op_id IS NULL THEN 'added' WHEN a.op_id IS NULL THEN 'removed' ELSE 'paired' END AS state
FROM (SELECT * FROM n WHERE run_id = 'A') b FULL JOIN (SELECT * FROM n WHERE run_id = 'B') a ON a.operator_id = b.operator_id AND a.nth = b.nth""")  # fmt: skip
def J22_stage_alignment(ev: Evidence) -> DataFrame:
    s = ev("spans").where("query_id = 'q0'").select("run_id", F.col("op_type").alias("operator_id"), "op_id", F.col("span_idx").alias("idx"))
    return J.align_stages(s.where("run_id = 'A'"), s.where("run_id = 'B' and op_id <> 'fast'"))


@on("V", """, d AS (SELECT query_id, doc_id FROM qrels WHERE grade = 2), g AS (SELECT s.*, d.doc_id FROM spans s JOIN d USING (query_id) WHERE run_id = 'A'),
io AS (SELECT trace_id, span_idx, doc_id, min(rank) FILTER (side = 'in') AS in_rank, min(rank) FILTER (side = 'out') AS out_rank FROM cands GROUP BY 1, 2, 3)
SELECT g.run_id, g.trace_id, g.query_id, g.doc_id, g.span_idx, g.op_id, CASE WHEN status <> 'FIRED' THEN 'skipped' WHEN out_rank IS NOT NULL THEN 'emitted' WHEN in_rank IS NOT NULL THEN 'removed' ELSE 'absent' END AS state, in_rank, out_rank
FROM g LEFT JOIN io USING (trace_id, span_idx, doc_id)""")  # fmt: skip
def W10_history_index(ev: Evidence) -> DataFrame:
    return J.history_index(ev("cands"), ev("spans").where("run_id = 'A'"), ev("qrels").where("grade = 2"))


def _context(ev: Evidence) -> D.Context:
    corpus = ev("embeddings").where("vec_id % 13 <> 5").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    return D.Context(ev("cands"), ev("spans"), ev("qrels"), corpus, cutoff=K)


_RULES = """, tr AS (SELECT trace_id, query_id, bool_and(output_capture = 'recorded') AS complete FROM spans GROUP BY 1, 2),
rl AS (SELECT DISTINCT tr.trace_id, q.doc_id FROM tr JOIN qrels q USING (query_id) WHERE grade > 0),
sp AS (SELECT s.trace_id, s.op_id, s.op_type, s.status, s.top_k, c.doc_id, c.side, c.rank, s.is_final FROM spans s JOIN cands c USING (trace_id, span_idx)),
src AS (SELECT DISTINCT trace_id, op_id, doc_id FROM sp WHERE op_type = 'SOURCE' AND side = 'out'), hit AS (SELECT src.* FROM src JOIN rl USING (trace_id, doc_id)),
fnd AS (
  SELECT 'qrel_absent_from_corpus' AS label, trace_id, doc_id FROM rl WHERE CAST(substr(doc_id, 2) AS BIGINT) % 13 = 5
  UNION ALL SELECT 'source_miss', trace_id, doc_id FROM rl ANTI JOIN src USING (trace_id, doc_id)
  UNION ALL SELECT 'branch_specific_miss', trace_id, doc_id FROM hit WHERE trace_id IN (SELECT trace_id FROM hit GROUP BY 1 HAVING count(DISTINCT op_id) = 1)
  UNION ALL SELECT lower(replace(replace(replace(op_type, 'FUSE', 'fusion'), 'RERANK', 'reranker'), 'FILTER', 'filter')) || '_loss', trace_id, doc_id FROM (SELECT trace_id, op_type, op_id, doc_id FROM sp WHERE op_type IN ('FUSE', 'FILTER', 'RERANK') AND status = 'FIRED' GROUP BY ALL HAVING count(*) FILTER (side = 'out') = 0) z JOIN rl USING (trace_id, doc_id)
  UNION ALL SELECT 'truncation_loss', trace_id, doc_id FROM (SELECT trace_id, op_id, doc_id FROM sp WHERE top_k IS NOT NULL GROUP BY ALL HAVING count(*) FILTER (side = 'out') = 0) z JOIN rl USING (trace_id, doc_id)
  UNION ALL SELECT 'ranking_failure', trace_id, doc_id FROM sp JOIN rl USING (trace_id, doc_id) WHERE is_final AND side = 'out' AND rank > 5),
lab AS (SELECT unnest(['qrel_absent_from_corpus', 'source_miss', 'branch_specific_miss', 'gate_exclusion', 'fusion_loss', 'filter_loss', 'reranker_loss', 'truncation_loss', 'ranking_failure']) AS label),
res AS (SELECT tr.trace_id, lab.label, tr.complete, count(DISTINCT f.doc_id) AS n FROM tr CROSS JOIN lab LEFT JOIN fnd f ON f.trace_id = tr.trace_id AND f.label = lab.label GROUP BY 1, 2, 3),
fin AS (SELECT trace_id, label, CASE WHEN label = 'source_miss' AND NOT complete THEN 'unavailable' WHEN label = 'gate_exclusion' THEN 'limited' WHEN n > 0 THEN 'supported' ELSE 'not_observed' END AS availability, n FROM res)"""
on("V", f"{_RULES} SELECT trace_id, label, availability, CASE WHEN availability = 'supported' THEN n ELSE 0 END AS n_documents FROM fin", name="D11_rule_engine")(lambda ev: D.evaluate(_context(ev)))
for _id, _rule in zip(("D01", "D02", "D03", "D04", "D06", "D07", "D08", "D09", "D10"), D.RULES, strict=True):
    _label = _rule.__name__ if _rule.__name__ != "rule" else {"D06": "fusion_loss", "D07": "filter_loss", "D08": "reranker_loss", "D09": "truncation_loss"}[_id]
    on("V", f"{_RULES} SELECT trace_id, label, availability, CASE WHEN availability = 'supported' THEN n ELSE 0 END AS n_documents FROM fin WHERE label = '{_label}'", name=f"{_id}_{_label}")(
        lambda ev, rule=_rule: rule(_context(ev))
    )


@on("V", f"{_RULES} SELECT label, availability, count(*) AS n, sum(CASE WHEN availability = 'supported' THEN n ELSE 0 END) AS documents FROM fin GROUP BY CUBE (label, availability)")
def A14_diagnostics_rollup(ev: Evidence) -> DataFrame:
    return D.rollup(D.evaluate(_context(ev)))


@on("V", """, f AS (SELECT c.trace_id, c.query_id, c.doc_id, c.side, c.parent_op_id, q.doc_id IS NOT NULL AS j FROM cands c LEFT JOIN qrels q ON q.query_id = c.query_id AND q.doc_id = c.doc_id WHERE op_id = 'fuse'),
d AS (SELECT trace_id, doc_id, j, count(DISTINCT parent_op_id) AS arms, bool_or(side = 'in') AS i, bool_or(side = 'out') AS o FROM f GROUP BY 1, 2, 3)
SELECT trace_id, count(*) FILTER (arms = 2) AS overlap_count, count(*) FILTER (j AND i) AS relevant_union, count(*) FILTER (j AND o) AS relevant_fused, count(*) FILTER (j AND arms = 1) AS unique_relevant,
  count(*) FILTER (j AND o) - count(*) FILTER (j AND i) AS fusion_gain FROM d GROUP BY 1""")  # fmt: skip
def N01_branch_analysis(ev: Evidence) -> DataFrame:
    return N.branches(ev("cands"), ev("spans"), ev("qrels"))


@on("V", """, h AS (SELECT DISTINCT trace_id FROM cands c JOIN qrels q ON q.query_id = c.query_id AND q.doc_id = c.doc_id WHERE op_id = 'select' AND side = 'out')
SELECT coalesce(route, status) AS route, count(*) AS traffic, count(h.trace_id) AS with_relevant, round(count(h.trace_id) * 1e0 / count(*), 6) AS recall FROM spans s LEFT JOIN h USING (trace_id) WHERE op_type = 'GATE' GROUP BY 1""")  # fmt: skip
def N02_gate_analysis(ev: Evidence) -> DataFrame:
    hits = ev("cands").where("op_id = 'select' and side = 'out'").join(ev("qrels"), ["query_id", "doc_id"])
    return N.gates(ev("spans"), hits).withColumn("recall", F.round("recall", 6))


_SCORED = """, sc AS (SELECT c.op_id, c.score, q.doc_id IS NOT NULL AS relevant FROM cands c LEFT JOIN qrels q ON q.query_id = c.query_id AND q.doc_id = c.doc_id WHERE side = 'out' AND run_id = 'A')"""


def _scored(ev: Evidence) -> DataFrame:
    q = ev("qrels").select("query_id", "doc_id", F.lit(True).alias("relevant"))
    return ev("cands").where("side = 'out' and run_id = 'A'").join(q, ["query_id", "doc_id"], "left").select("op_id", "score", F.coalesce("relevant", F.lit(False)).alias("relevant"))


@on("V", f"""{_SCORED}, m AS (SELECT *, min(score) OVER (PARTITION BY op_id) AS lo, max(score) OVER (PARTITION BY op_id) AS hi FROM sc)
SELECT op_id, CAST(CASE WHEN hi = lo THEN 0 ELSE least(9, floor((score - lo) / ((hi - lo) / 10))) END AS INT) AS bin, count(*) AS n, round(avg(CAST(relevant AS INT)), 6) AS relevance_rate FROM m GROUP BY 1, 2""")  # fmt: skip
def N03_calibration(ev: Evidence) -> DataFrame:
    return N.calibration(_scored(ev), ["op_id"]).withColumn("relevance_rate", F.round("relevance_rate", 6))


@on("V", f"""{_SCORED} SELECT DISTINCT op_id, score AS threshold, count(*) OVER w AS selected, round(avg(CAST(relevant AS INT)) OVER w, 6) AS precision FROM sc WINDOW w AS (PARTITION BY op_id ORDER BY score DESC)""")
def N03_thresholds(ev: Evidence) -> DataFrame:
    return N.thresholds(_scored(ev), ["op_id"]).withColumn("precision", F.round("precision", 6))


_ORDER = ["dense", "lexical", "filter", "fuse", "gate", "rerank", "fast", "expand", "select"]
_PARENTS = {"filter": ["lexical"], "fuse": ["dense", "filter"], "gate": ["fuse"], "rerank": ["gate"], "fast": ["gate"], "expand": ["rerank", "fast"], "select": ["expand"]}
_PATH = """, l AS (SELECT run_id, trace_id, op_id, CASE WHEN status = 'FIRED' THEN latency_ms ELSE 0 END AS ms FROM spans), p AS (PIVOT l ON op_id USING sum(ms) GROUP BY run_id, trace_id)
SELECT run_id, trace_id, greatest(dense, lexical + filter) + fuse + gate + greatest(rerank, fast) + expand + "select" AS critical_path_ms, dense + lexical + filter + fuse + gate + rerank + fast + expand + "select" AS operator_sum FROM p"""
on("V", _PATH.replace("(PIVOT l ON op_id USING sum(ms) GROUP BY run_id, trace_id)", "(SELECT run_id, trace_id, " + ", ".join(f"sum(ms) FILTER (op_id = '{o}') AS \"{o}\"" for o in _ORDER) + " FROM l GROUP BY 1, 2)"), name="A21_critical_path")(
    lambda ev: N.critical_path(ev("spans"), _ORDER, _PARENTS)
)


@on("V", "SELECT run_id, round(avg(CASE WHEN status = 'FIRED' THEN latency_ms END), 6) AS mean_latency, sum(latency_ms) FILTER (status = 'FIRED') AS total_ms, count(*) FILTER (status = 'FIRED') AS spans FROM spans GROUP BY 1")
def N04_latency_analysis(ev: Evidence) -> DataFrame:
    s = ev("spans").where("status = 'FIRED'")
    return s.groupBy("run_id").agg(F.round(F.avg("latency_ms"), 6).alias("mean_latency"), F.sum("latency_ms").alias("total_ms"), F.count("*").alias("spans"))


@on("V", """SELECT (SELECT count(DISTINCT query_id) FROM spans) AS queries, (SELECT count(DISTINCT query_id) FROM qrels WHERE grade = 2 AND query_id IN (SELECT query_id FROM spans)) AS judged_queries,
  (SELECT count(*) FROM qrels WHERE grade = 2 AND query_id NOT IN (SELECT query_id FROM spans)) AS orphan_queries, (SELECT count(*) FROM qrels WHERE grade = 2 AND CAST(substr(doc_id, 2) AS BIGINT) % 13 = 5) AS orphan_documents""")  # fmt: skip
def N05_ground_truth(ev: Evidence) -> DataFrame:
    corpus = ev("embeddings").where("vec_id % 13 <> 5").select(F.concat(F.lit("d"), "vec_id").alias("doc_id"))
    return N.ground_truth(ev("qrels").where("grade = 2"), ev("spans"), corpus)


@on("V", "SELECT DISTINCT op_id, CASE WHEN op_id = 'gate' THEN 'undeclared' ELSE 'observed' END AS state FROM spans UNION ALL SELECT 'cache', 'missing'")
def N06_instrumentation(ev: Evidence) -> DataFrame:
    s = ev("spans").select("op_id")
    return N.instrumentation(s.where("op_id <> 'gate'").union(s.sparkSession.createDataFrame([("cache",)], "op_id string")), s)


@on("V", """, i AS (SELECT run_id, avg(CAST(candidate_id IS NOT NULL AS INT)) AS identity, avg(CAST(doc_id IS NOT NULL AS INT)) AS document_identity FROM cands GROUP BY 1),
x AS (SELECT run_id, round(avg(CAST(r IS NOT NULL AS INT)), 6) AS exit_reason FROM (SELECT run_id, trace_id, span_idx, candidate_id, max(reason) AS r FROM cands GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (side = 'out') = 0) GROUP BY 1)
SELECT i.*, x.exit_reason, round(s.io, 6) AS io, s.partial FROM i JOIN x USING (run_id) JOIN (SELECT run_id, avg(CAST(output_capture = 'recorded' AS INT)) AS io, count(*) FILTER (output_capture <> 'recorded') AS partial FROM spans WHERE status = 'FIRED' GROUP BY 1) s USING (run_id)""")  # fmt: skip
def A28_lineage_coverage(ev: Evidence) -> DataFrame:
    return N.lineage_coverage(ev("cands"), ev("spans")).withColumns({"io": F.round("io", 6), "exit_reason": F.round("exit_reason", 6)})


@on("V", """, e AS (SELECT run_id, trace_id, concat_ws('|', op_id, op_type, array_to_string(list_sort(string_split(parents, ',')), ','), status) AS s FROM spans)
SELECT run_id, topology, count(*) AS traces FROM (SELECT run_id, trace_id, sha256(string_agg(DISTINCT s, ';' ORDER BY s)) AS topology FROM e GROUP BY 1, 2) GROUP BY 1, 2""")  # fmt: skip
def F27_topology_hash(ev: Evidence) -> DataFrame:
    return N.topology(ev("spans"))


@on("V", """SELECT run_id, op_id, op_type, count(*) AS traces, round(avg(CAST(status = 'FIRED' AS INT)), 6) AS fire_rate, round(avg(latency_ms) FILTER (status = 'FIRED'), 6) AS mean_latency,
  round(quantile_cont(latency_ms, 0.95) FILTER (status = 'FIRED'), 6) AS p95_latency FROM spans GROUP BY 1, 2, 3""")  # fmt: skip
def A20_graph_nodes(ev: Evidence) -> DataFrame:
    return N.graph_nodes(ev("spans")).withColumns({c: F.round(c, 6) for c in ("fire_rate", "mean_latency", "p95_latency")})


@on("V", """SELECT run_id, parent, op_id, count(*) FILTER (status = 'FIRED') AS fired, count(*) AS traces, count(*) FILTER (status = 'FIRED') < count(*) AS conditional
FROM (SELECT run_id, op_id, status, unnest(string_split(parents, ',')) AS parent FROM spans) WHERE parent <> '' GROUP BY 1, 2, 3""")  # fmt: skip
def A20_graph_edges(ev: Evidence) -> DataFrame:
    return N.graph_edges(ev("spans"))


@on("V", "SELECT run_id, count(*) FILTER (output_capture <> 'recorded') AS incomplete FROM spans GROUP BY 1")
def A40_incomplete_boundaries(ev: Evidence) -> DataFrame:
    return ev("spans").groupBy("run_id").agg(F.count_if(F.col("output_capture") != "recorded").alias("incomplete"))


@on("V", "SELECT trace_id, bool_or(output_capture <> 'recorded') AS partial FROM spans GROUP BY 1")
def A42_partial_traces(ev: Evidence) -> DataFrame:
    return ev("spans").groupBy("trace_id").agg(F.bool_or(F.col("output_capture") != "recorded").alias("partial"))


@on("V", "SELECT trace_id, op_id, count(*) - count(DISTINCT rank) AS repeated_ranks, count(*) FILTER (rank < 1) AS bad_ranks FROM cands WHERE side = 'out' GROUP BY 1, 2")
def R44_trace_invariants(ev: Evidence) -> DataFrame:
    return ev("cands").where("side = 'out'").groupBy("trace_id", "op_id").agg((F.count("*") - F.countDistinct("rank")).alias("repeated_ranks"), F.count_if(F.col("rank") < 1).alias("bad_ranks"))


@on("G", "SELECT dst, edge_type, weight FROM edges WHERE src = 'd1'")
def J18_graph_neighbours(ev: Evidence) -> DataFrame:
    return ev("edges").where("src = 'd1' and edge_type = 'next'").select("dst", "edge_type", "weight")


_REACH = """, h0 AS (SELECT DISTINCT src AS doc_id FROM edges WHERE CAST(substr(src, 2) AS BIGINT) % 100 = 0), h1 AS (SELECT DISTINCT dst AS doc_id FROM h0 JOIN edges ON src = doc_id WHERE dst NOT IN (SELECT doc_id FROM h0)),
h2 AS (SELECT DISTINCT dst AS doc_id FROM h1 JOIN edges ON src = doc_id WHERE dst NOT IN (SELECT doc_id FROM h0 UNION SELECT doc_id FROM h1)),
rc AS (SELECT doc_id, 0 AS hops FROM h0 UNION ALL SELECT doc_id, 1 FROM h1 UNION ALL SELECT doc_id, 2 FROM h2)"""


def _reach(ev: Evidence) -> DataFrame:
    e = ev("edges")
    return N.reachable(e, e.where(F.substring("src", 2, 20).cast("long") % 100 == 0).select(F.col("src").alias("doc_id")), 2, "next")


@on("G", f"{_REACH} SELECT * FROM rc")
def J19_bounded_reachability(ev: Evidence) -> DataFrame:
    return _reach(ev)


@on("G", f"{_REACH} SELECT e.dst AS doc_id, rc.doc_id IS NOT NULL AS reachable FROM (SELECT DISTINCT dst FROM edges WHERE CAST(substr(dst, 2) AS BIGINT) % 7 = 0) e LEFT JOIN rc ON rc.doc_id = e.dst")
def J20_gold_reachable(ev: Evidence) -> DataFrame:
    gold = ev("edges").where(F.substring("dst", 2, 20).cast("long") % 7 == 0).select(F.col("dst").alias("doc_id")).distinct()
    return gold.join(_reach(ev).withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("reachable"))
